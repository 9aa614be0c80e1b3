"""Document fingerprints by consistent weighted sampling, in SQL expressions.

The terms of a document are its lower-cased words, weighted by how often they
occur.  For each term and each of ``SAMPLES`` samples two gamma(2, 1) values
``r`` and ``c`` and a uniform ``b`` come from hashes of the term.  With
``t = floor(ln(weight) / r + b)`` the sample of a document is the term and
``t`` with the smallest ``ln c - r (t - b) - r``.  Two documents agree in a
sample with the chance of their generalised Jaccard similarity
``sum(min) / sum(max)``.

The smallest value and what it belongs to share one long (order in the upper
bits, a hash of term and ``t`` in the lower), so ``SAMPLES`` plain ``min``
aggregates do the work.  Documents are dealt by id once; counting the terms of
a document and taking its minima need no other shuffle, and a hot id is only
as large as the texts that have it.

Defined results: a null text is empty; a text without terms has the
fingerprint of zeros, is like another such text with 1 and like others with 0;
the next document of the last in descending order is the first; rows with null
ids come last; of rows with the same id and text each gets the same result, and
of texts with the same id that with the smallest hash is the next one; an empty
table gives no rows; a very long text is one row like any other, and only its
distinct words are held at once; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import column, cut, input_bytes

SAMPLES = 24
#: Bytes of input for each task, about.
PART_BYTES = 8 << 20
_BITS = 24
_LEAST = -(2**63)  # stands for a null id


def _uniform(h: Column, shift: int) -> Column:
    """A number in (0, 1) from 21 bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0x1FFFFF)).cast("double") + 0.5) * (2.0**-21)


def sample(term: Column, weight_ln: Column, i: int) -> Column:
    """What a term offers to sample ``i``, as a long whose order is the sampling order."""
    g, h = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
    r = -F.ln(_uniform(g, 0) * _uniform(g, 21))
    c = -F.ln(_uniform(g, 42) * _uniform(h, 0))
    b = _uniform(h, 21)
    t = F.floor(weight_ln / r + b)
    order = F.ln(c) - r * (t - b) - r
    # from -64 to 64 in steps of 2^-31, over 24 bits of what it belongs to
    high = F.greatest(F.lit(0.0), F.least(F.lit(2.0**39 - 1), (order + 64) * (2.0**32))).cast("long")
    return F.shiftleft(high, _BITS).bitwiseOR(F.xxhash64(h, t).bitwiseAND(F.lit((1 << _BITS) - 1)))


def next_keys(ids: DataFrame) -> DataFrame:
    """(k, next_k, next_of): what follows each key in descending order, the first after the last.

    ``ids`` has each key k once, with ``of``.  Only these longs are sorted: by
    range, then inside each range, with one row for each range to step over its
    end.
    """
    down = F.col("k").desc()
    w = W.partitionBy("part").orderBy(down)
    after = F.lead(F.struct("k", "of"))
    ranged = ids.repartitionByRange(down).withColumn("part", F.spark_partition_id())
    inner = cut(ranged.select("part", "k", "of", F.row_number().over(w).alias("nth"), after.over(w).alias("next")))
    heads = inner.filter("nth = 1").select("part", F.struct("k", "of").alias("head"))
    order = W.orderBy("part")  # one row for each range
    step = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).alias("after"))
    out = inner.join(F.broadcast(step), "part").select("k", F.coalesce("next", "after").alias("x"))
    return out.select("k", F.col("x.k").alias("next_k"), F.col("x.of").alias("next_of"))


def signatures(texts: DataFrame, keys: list[str], text_col: str, times: str | None = None, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and s0..: the samples of each text that has terms.

    ``times`` names how many equal rows a text has; they count once.  Where
    ``texts`` is partitioned by some of the keys there is no shuffle.
    """
    words = F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+")
    own = [*keys, times] if times else keys
    terms = texts.select(*own, F.explode(words).alias("term")).filter("term != ''").select(*own, F.xxhash64("term").alias("term"))
    counted = terms.groupBy(*own, "term").agg(F.count("*").alias("w")).withColumn("w", F.ln(F.col("w") / F.col(times)) if times else F.ln("w"))
    mins = counted.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("w"), i)).alias(f"s{i}") for i in range(samples)])
    return mins.select(*keys, *[F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1)).alias(f"s{i}") for i in range(samples)])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal samples."""
    same = reduce(lambda x, y: x + y, [(p == q).cast("int") for p, q in zip(a, b, strict=True)])
    return same / F.lit(float(len(a)))


def as_text(samples: list[Column]) -> Column:
    """A fingerprint as hexadecimal digits, eight for each sample."""
    return F.concat(*[F.lpad(F.lower(F.hex(v)), 8, "0") for v in samples])


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last third replaced by as much of the start of the
    next document in descending order of ids.
    """
    parts = int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4, 2 * input_bytes(docs) // PART_BYTES))
    src = docs.select(F.coalesce(column(id_col).cast("long"), F.lit(_LEAST)).alias("k"), F.coalesce(column(text_col), F.lit("")).alias("text")).withColumn("of", F.xxhash64("text"))
    rows = cut(src.groupBy("k", "of").agg(F.count("*").alias("times"), F.max(F.length("text")).alias("n")))
    follow = next_keys(rows.groupBy("k").agg(F.min("of").alias("of")))
    rows = cut(rows.join(follow, "k").withColumn("third", F.floor(F.col("n") / 3).cast("int")))

    own = src.repartition(parts, "k", "of")  # the only shuffle of the texts: all that follows is by these keys
    asked = rows.select(F.col("k").alias("for_k"), F.col("of").alias("for_of"), F.col("next_k").alias("k"), F.col("next_of").alias("of"), "third")
    heads = own.join(asked.hint("shuffle_hash"), ["k", "of"]).select("for_k", "for_of", F.expr("substring(text, 1, third)").alias("head"))
    heads = heads.repartition(parts, "for_k", "for_of").dropDuplicates(["for_k", "for_of"]).select(F.col("for_k").alias("k"), F.col("for_of").alias("of"), "head")
    cut_off = F.expr("substring(text, 1, length(text) - int(floor(length(text) / 3)))")
    both = own.join(heads.hint("shuffle_hash"), ["k", "of"]).join(rows.select("k", "of", "times").hint("shuffle_hash"), ["k", "of"])
    both = both.select("k", "of", "times", "text", F.concat(cut_off, "head").alias("edited"))
    two = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    texts = both.select("k", "of", "times", two.alias("x")).select("k", "of", "times", "x.kind", "x.t")
    names = [f"s{i}" for i in range(samples)]
    by_kind = signatures(texts, ["k", "of", "kind"], "t", "times", samples)
    pair = by_kind.groupBy("k", "of").agg(*[F.max(F.when(F.col("kind") == kind, F.col(s))).alias(f"{s}_{kind}") for kind in (0, 1) for s in names])
    digests = both.select("k", "of", F.sha2("edited", 256).alias("d")).groupBy("k", "of").agg(F.max("d").alias("edited_sha256"))
    signed = digests.join(pair, ["k", "of"], "left").select("k", "of", "edited_sha256", *[F.coalesce(c, F.lit(0)).alias(c) for c in pair.columns[2:]])
    signed = cut(signed)
    after = signed.select(F.col("k").alias("next_k"), F.col("of").alias("next_of"), *[F.col(f"{s}_0").alias(f"{s}_n") for s in names])
    a, b, c = ([F.col(f"{s}_{x}") for s in names] for x in (0, 1, "n"))
    out = signed.join(rows, ["k", "of"]).join(after, ["next_k", "next_of"])
    out = out.select(
        F.when(F.col("k") != _LEAST, F.col("k")).alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), "times",
    )
    # one row for each row of the input
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
