"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words.  The minimiser of a window is the
leftmost run of ``MINIMISER`` words in it with the smallest hash, so equal
windows have equal minimisers.  Consecutive windows of a document that share a
minimiser travel as one packed string (a super-k-mer: its words joined by one
space) to the bucket of that minimiser.  There the windows of all strings are
sorted by hash, and windows of one hash are compared byte by byte, so the
counts are exact.

Equal super-k-mers of one map chunk are packed once: a passage that a third of
all documents share reaches its bucket once per chunk, not once per document.
That its copies repeat is known in the map task already; those go, salted, to
any bucket.

Defined results: a null text has no words; a text shorter than the window
loses nothing; repeated rows are separate documents, so each is a copy of the
other; a null id is an id like any other; an empty table gives no rows; a very
long text is cut into super-k-mers whole, in a chunk of its own.  Other
columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, U, arrow_session, chunks, column, input_bytes, mix64, numbered, rolling, text_bytes, tidy, word_hashes, word_spans

#: Words of a minimiser.
MINIMISER = 4
#: Text bytes that are cut into super-k-mers at once.
MAP_BYTES = 4 << 20
#: Packed bytes that a bucket should hold.
BUCKET_BYTES = 4 << 20
#: Text bytes of a task of the join with what repeats.
JOIN_BYTES = 64 << 20
#: Buckets that a task works through, one after the other.
BUCKETS_AT_ONCE = 8
#: Packed bytes for each byte of text, about: (windows + window - 1) / windows.
OVERLAP = 3

_RUN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i4"), ("count", "<i4")])
_PACK = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i4"), ("count", "<i4"), ("bytes", "<i4"), ("twice", "<i4")])


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two longs that tell documents apart, a null id and repeated ids included."""
    return [F.coalesce(column(id_col).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(column(text_col)).alias("k2")]


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost smallest value in each run of ``span`` values."""
    n = len(h) - span + 1
    value, place, size = h.copy(), np.arange(len(h)), 1
    out_v, out_p, have, rest = None, None, 0, span
    while rest:
        if rest & 1:
            v, p = value[have : have + n], place[have : have + n]
            if out_v is None:
                out_v, out_p = v.copy(), p.copy()
            else:
                less = v < out_v
                out_v, out_p = np.where(less, v, out_v), np.where(less, p, out_p)
            have += size
        rest >>= 1
        if rest:
            less = value[size:] < value[:-size]
            value, place = np.where(less, value[size:], value[:-size]), np.where(less, place[size:], place[:-size])
            size *= 2
    return out_p


def _super_kmers(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple:
    """First word, number of windows, minimiser hash of each super-k-mer."""
    starts, stops, bounds = word_spans(data, offsets, SPACE)
    words = len(starts)
    m = min(MINIMISER, window)
    if words < window:
        return starts, stops, bounds, *(np.zeros(0, np.int64) for _ in range(3))
    grams = rolling(word_hashes(data, starts, stops), m)
    place = _least(grams, window - m + 1)
    doc = np.searchsorted(bounds, np.arange(words), side="right") - 1
    valid = doc[: words - window + 1] == doc[window - 1 :]
    new = np.ones(len(valid), bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    last = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
    return starts, stops, bounds, first, last - first + 1, grams[place[first]]


def _map(window: int, buckets: int):
    """Map side: documents to (bucket, compressed super-k-mers and runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for i, j in chunks(offsets, MAP_BYTES):
                part = data[offsets[i] : offsets[j]]
                out = _pack(part, offsets[i : j + 1] - offsets[i], k1[i:j], k2[i:j], window, buckets, squeeze)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "blob"])
                del out, part
            del data
        tidy()

    return run


def _pack(data, offsets, k1, k2, window, buckets, squeeze) -> list[tuple[int, bytes]]:
    starts, stops, bounds, first, count, minimiser = _super_kmers(data, offsets, window)
    if not len(first):
        return []
    doc = np.searchsorted(bounds, first, side="right") - 1
    own = np.zeros(len(first), _PACK)
    own["k1"], own["k2"], own["start"], own["count"] = k1[doc], k2[doc], first - bounds[doc], count
    # white space becomes one space, so that equal words are equal bytes
    keep = ~SPACE[data]
    keep[np.minimum(stops, len(data) - 1)] |= SPACE[data[np.minimum(stops, len(data) - 1)]]
    place = np.concatenate([[0], np.cumsum(keep)])
    flat = np.where(SPACE[data], np.uint8(0x20), data)[keep].tobytes()
    a, b = place[starts[first]], place[stops[first + count + window - 2] - 1] + 1
    own["bytes"] = b - a
    # equal super-k-mers of this chunk: by minimiser and length, then by bytes
    ends = mix64(minimiser * U(3) + (b - a).astype(U) * U(0x9E3779B97F4A7C15) + count.astype(U))
    order = np.argsort(ends, kind="stable")
    same = ends[order][1:] == ends[order][:-1]
    leader = np.arange(len(first))
    if same.any():
        group: dict[bytes, int] = {}
        for at in np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])):
            x = order[at]
            leader[x] = group.setdefault(flat[a[x] : b[x]], x)
    copies = np.bincount(leader, minlength=len(first))
    lead = leader == np.arange(len(first))
    own["twice"] = copies > 1
    bucket = (mix64(minimiser + U(11)) % U(buckets)).astype(np.int64)
    # copies that are known to repeat need no answer; they are dealt out evenly
    known = np.flatnonzero(copies[leader] > 1)
    runs = np.zeros(len(known), _RUN)
    for f in _RUN.names:
        runs[f] = own[f][known]
    runs_bucket = (mix64(known.astype(U) + U(int(k2[0]) & (2**63 - 1))) % U(buckets)).astype(np.int64)
    sent = np.flatnonzero(lead)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    known_order = np.argsort(runs_bucket, kind="stable")
    names = np.unique(np.concatenate([bucket[sent], runs_bucket]))
    s0, s1 = np.searchsorted(bucket[sent], names), np.searchsorted(bucket[sent], names, side="right")
    r0, r1 = np.searchsorted(runs_bucket[known_order], names), np.searchsorted(runs_bucket[known_order], names, side="right")
    out = []
    for name, i, j, p, q in zip(names.tolist(), s0, s1, r0, r1, strict=True):
        rows = sent[i:j]
        text = b"".join([flat[x:y] for x, y in zip(a[rows].tolist(), b[rows].tolist(), strict=True)])
        head = np.array([j - i, q - p], "<i4").tobytes()
        out.append((name, squeeze.compress(head + own[rows].tobytes() + runs[known_order[p:q]].tobytes() + text)))
    return out


def _count(window: int):
    """Reduce side: the windows of a bucket that occur more than once."""

    def run(table: pa.Table) -> pa.Table:
        un = zstandard.ZstdDecompressor()
        packs, runs, texts = [], [], []
        for blob in table.column("blob").to_pylist():
            raw = un.decompress(blob)
            n, r = np.frombuffer(raw, "<i4", 2)
            at = 8 + n * _PACK.itemsize
            packs.append(np.frombuffer(raw, _PACK, n, 8))
            runs.append(np.frombuffer(raw, _RUN, r, at))
            texts.append(raw[at + r * _RUN.itemsize :])
        pack, out = np.concatenate(packs), np.concatenate(runs)
        flat = b"".join(texts)
        del texts
        if len(pack):
            found = _repeats(pack, flat, window)
            out = np.concatenate([out, found]) if len(found) else out
        return pa.table({f: pa.array(out[f]) for f in _RUN.names})

    return run


def _repeats(pack: np.ndarray, flat: bytes, window: int) -> np.ndarray:
    data = np.frombuffer(flat, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(pack["bytes"], dtype=np.int64)])
    hashes, begin, end, owner, nth = [], [], [], [], []
    for i, j in chunks(offsets):
        base = offsets[i]
        off = offsets[i : j + 1] - base
        starts, stops, bounds = word_spans(data[base : offsets[j]], off, SPACE)
        h = rolling(word_hashes(data[base : offsets[j]], starts, stops), window)
        c = pack["count"][i:j].astype(np.int64)
        inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        at = np.repeat(bounds[:-1], c) + inner
        hashes.append(h[at])
        begin.append(starts[at] + base)
        end.append(stops[at + window - 1] + base)
        owner.append(np.repeat(np.arange(i, j), c))
        nth.append(inner)
    hashes, begin, end, owner, nth = (np.concatenate(x) for x in (hashes, begin, end, owner, nth))
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    repeat = pack["twice"][owner] > 0  # by window, in the order of the strings
    group = np.concatenate([[0], np.cumsum(~same)])
    many = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    rows = order[many]
    at, n = 0, len(many)
    groups = group[many]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [n]]) if n else np.zeros(1, int)
    b, e = begin.tolist() if n else [], end.tolist() if n else []
    for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        members = rows[at:to].tolist()
        x = flat[b[members[0]] : e[members[0]]]
        if all(flat[b[m] : e[m]] == x for m in members[1:]):
            repeat[members] = True
            continue
        exact: dict[bytes, list[int]] = {}  # windows that only share a hash
        for m in members:
            exact.setdefault(flat[b[m] : e[m]], []).append(m)
        for group_rows in exact.values():
            if len(group_rows) > 1:
                repeat[group_rows] = True
    ask = pack["twice"][owner] == 0
    hit = np.flatnonzero(repeat & ask)
    if not len(hit):
        return np.zeros(0, _RUN)
    new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)])
    first = np.flatnonzero(new)
    out = np.zeros(len(first), _RUN)
    who = owner[hit[first]]
    out["k1"], out["k2"] = pack["k1"][who], pack["k2"][who]
    out["start"] = pack["start"][who] + nth[hit[first]]
    out["count"] = np.diff(np.concatenate([first, [len(hit)]]))
    return out


def repeated_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of window starts whose words also start elsewhere: (k1, k2, start, count)."""
    spark = arrow_session(docs.sparkSession)
    src = docs.select(*row_key(id_col, text_col), column(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # an upper estimate of the bytes; columnar files are smaller than their texts
    buckets = max(BUCKETS_AT_ONCE * parts, 2 * input_bytes(src) * OVERLAP // BUCKET_BYTES)
    packed = src.mapInArrow(_map(window, buckets), "bucket long, blob binary")
    # as many tasks as the buckets ask for, so that what a task reads does not grow with the table
    packed = packed.repartition(int(buckets // BUCKETS_AT_ONCE), "bucket")
    return packed.groupBy("bucket").applyInArrow(_count(window), "k1 long, k2 long, start int, count int")


def _remove(window: int, texts: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_text"))
            runs = batch.column("_runs").to_pylist()
            n_words, n_removed, sha, kept_text = [], [], [], []
            for i, j in chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, stops, bounds = word_spans(part, offsets[i : j + 1] - offsets[i], SPACE)
                delta = np.zeros(len(starts) + 1, np.int32)
                for d in range(i, j):
                    for r in runs[d] or ():
                        at = bounds[d - i] + r["start"]
                        delta[at] += 1
                        delta[at + r["count"] + window - 1] -= 1
                gone = np.cumsum(delta[:-1]) > 0
                flat = part.tobytes()
                s, e = starts.tolist(), stops.tolist()
                for d in range(j - i):
                    lo, hi = int(bounds[d]), int(bounds[d + 1])
                    out = gone[lo:hi]
                    left = (np.flatnonzero(~out) + lo).tolist()
                    text = b" ".join([flat[s[w] : e[w]] for w in left])
                    n_words.append(hi - lo)
                    n_removed.append(int(out.sum()))
                    if texts:
                        kept_text.append(text.decode() if out.any() else None)
                    else:
                        sha.append(hashlib.sha256(text).hexdigest())
            cols = [batch.column(c) for c in keep] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            cols.append(pa.array(kept_text, pa.string()) if texts else pa.array(sha, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*keep, "n_words", "n_removed", "kept_text" if texts else "kept_sha256"])
        tidy()

    return run


def _with_runs(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    runs = repeated_windows(docs, window, id_col, text_col).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "count")).alias("_runs"))
    k1, k2 = row_key(id_col, text_col)
    spark = docs.sparkSession
    # the smaller side is hashed in memory: so many tasks that a task's share of it is bounded
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * input_bytes(docs) // JOIN_BYTES)
    left = docs.withColumn("_k1", k1).withColumn("_k2", k2).repartition(int(parts), "_k1", "_k2")
    runs = runs.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_runs")
    return left.join(runs.hint("shuffle_hash"), ["_k1", "_k2"], "left")


def removal_report(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256."""
    src = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"))
    joined = _with_runs(src, window, "_id", "_text").select("_id", "_text", "_runs")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(_remove(window, False, ["_id"]), f"_id {kind}, n_words long, n_removed long, kept_sha256 string")
    return out.toDF(id_col, *out.columns[1:])


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the repeated words; a text that loses none stays as it is.

    ``n_chars`` follows the text where there is such a column.
    """
    names = docs.columns
    renamed = numbered(docs)
    i, t = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    joined = _with_runs(renamed, window, i, t).select(*renamed.columns, F.col(t).alias("_text"), "_runs")
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(renamed.columns, docs.schema.fields, strict=True))
    out = joined.mapInArrow(_remove(window, True, renamed.columns), f"{schema}, n_words long, n_removed long, kept_text string")
    out = out.withColumn(t, F.coalesce("kept_text", t))
    if "n_chars" in names:
        n = f"_c{names.index('n_chars')}"
        out = out.withColumn(n, F.when(F.col("n_removed") > 0, F.length(t)).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return out.select(*renamed.columns).toDF(*names)
