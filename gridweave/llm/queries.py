"""One thin query for each text operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprints, language_id, near_dedup, quality, substring_dedup, token_store, url_filters, warc
from ._common import crc_mod

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.store_report(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"], ids=False, digests=True)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id") == 1).alias("held_out"), "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contained_items(docs, _table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


#: The rules of the URL filter query.
RULES = [
    url_filters.Rule("allow", "org", "/"), url_filters.Rule("block", "example.org", "/es/"), url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"), url_filters.Rule("block", "com", "/de/"),
]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_pages(_table(spark, sf_dir, "pages"), RULES)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    out = language_id.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id") == 1).alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, threshold=0.8)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"), min_bytes=0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it is made of this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op10_fingerprints": op10_fingerprints,
        "op1_token_store": op1_token_store,
        "op2_bpe": op2_bpe,
        "op3_quality": op3_quality,
        "op4_decontaminate": op4_decontaminate,
        "op5_url_filters": op5_url_filters,
        "op6_language_id": op6_language_id,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_near_dedup": op8_near_dedup,
        "op9_warc": op9_warc,
        "pipeline": pipeline,
    }


_OP7 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
g AS (SELECT doc_id, i, array_to_string(words[i:i+34], ' ') AS win FROM s),
c AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
d AS (SELECT g.doc_id, g.i FROM g SEMI JOIN c USING (win)),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
f AS (SELECT p.doc_id, p.word, p.i, max(d.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last FROM p LEFT JOIN d ON p.doc_id = d.doc_id AND p.i = d.i),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE last IS NOT NULL AND i - last < 35) AS n_removed,
             coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i - last >= 35), '') AS kept FROM f GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


_OP4 = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS words FROM t),
s AS (SELECT kind, id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0),
g AS (SELECT DISTINCT kind, id, array_to_string(words[i:i+4], ' ') AS sh FROM s),
n AS (SELECT id, count(*) AS n FROM g WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) / any_value(n.n) AS containment
FROM g b JOIN g d ON b.kind = 'b' AND d.kind = 'd' AND b.sh = d.sh JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) / any_value(n.n) >= 0.8
"""


_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, payload, octet_length(encode(payload)) AS n, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((
           (strpos('0123456789abcdef', substr(hex, CAST((5 * i) // 4 + 1 AS BIGINT), 1)) - 1) * 16
           + greatest(strpos('0123456789abcdef', substr(hex, CAST((5 * i) // 4 + 2 AS BIGINT), 1)) - 1, 0))
           // CAST(pow(2, 3 - (5 * i) % 4) AS BIGINT)) % 32 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM h
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    known = {"op4_decontaminate": _OP4, "op7_substring_dedup": _OP7, "op9_warc": _OP9, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in known.items() if sql}
