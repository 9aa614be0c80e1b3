"""The corpus pipeline: raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's documents.  All stages but
the last return the columns of ``documents``, other columns included and
whatever their names.

Defined results: a null or empty text has no language and goes; of rows alike
one stays; of very long texts all words count in each stage; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridweave.llm import bpe, decontaminate, language_id, near_dedup, substring_dedup
from gridweave.llm._common import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language."""
    return language_id.keep_clear(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates."""
    return near_dedup.keep_one_of_each(docs, k=5, threshold=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of 35-word windows that occur more than once."""
    return substring_dedup.remove_repeats(docs, window=35)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs, items, k=5, threshold=0.8)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, path, keep=["doc_id", "lang", "source"], ids=True, digests=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("tokens", to_tokens),
]

#: SQL cannot express language ID, near-duplicate classes or BPE; a test compares run() with plain versions of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
