"""Training-data operators: tokens, quality, dedup, language, URLs, archives.

Nothing outside this folder and ``corpus_pipeline.py`` imports it, so that it
can be taken out without touching the rest of the library.
"""
