"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, in powers of two.  For the
partition of items with up to ``n`` shingles every document is read as
overlapping segments of ``2n`` shingles, ``n`` apart, so that an item lies
whole in some segment whose size is near its own and the Jaccard similarity of
the two is high however long the document is.  ``HASHES`` MinHash values of
each segment are looked up among those of the items; a single equal value makes
a candidate, which is verified by exact containment of the item's shingles
(word runs, compared as text) in the whole document.

Segments are unions of blocks, so each shingle is hashed once for each hash
function and block minima are combined from then on.  Partitions below
``SMALL`` shingles have blocks of their own.  There is no shuffle: the items
are sent to the workers in slices of bounded size, and each worker builds the
tables of a slice once.

Words are lower-cased runs of letters, digits and non-ASCII characters.
Defined results: null texts have no words; an item or a document of fewer than
``k`` words has one shingle, of all its words; an item without words is never
found; repeated documents are each reported; repeated items are each reported;
without documents or items there are no rows; a very long document is searched
whole, in a chunk of its own; columns are told apart by place, whatever their
names, and where documents and items name their ids alike the item's gets
``item_`` before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NON_WORD, U, arrow_session, chunks, column, numbered, seeds, shingles, text_bytes, tidy, word_hashes, word_spans

#: MinHash values of a segment or an item.
HASHES = 48
#: Items that are sent to the workers at once; more items mean more passes.
SLICE_ITEMS = 20_000
#: Characters of items that are sent to the workers at once.
SLICE_CHARS = 8 << 20
#: Shingles from which size partitions share their blocks.
SMALL = 8
_MIX = seeds(HASHES, 4)


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(texts, lower=True)
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, stops, bounds = word_spans(part, offsets[i : j + 1] - offsets[i], NON_WORD)
        yield i, j, part, starts, stops, bounds, word_hashes(part, starts, stops)


def exact_shingles(words: list[bytes], k: int) -> set[bytes]:
    """The shingles of a text as the texts of their words."""
    if not words:
        return set()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


class _Items:
    """The items of a slice, by size partition, with their MinHash values."""

    def __init__(self, ids: list[int | None], texts: list[str | None], k: int) -> None:
        self.ids, self.sets = ids, []
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, j, part, starts, stops, bounds, h in _words(pa.array(texts, pa.string())):
            sh, at = shingles(h, bounds, k)
            flat, s, e = part.tobytes(), starts.tolist(), stops.tolist()
            for d in range(j - i):
                lo, hi = int(bounds[d]), int(bounds[d + 1])
                self.sets.append(exact_shingles([flat[s[w] : e[w]] for w in range(lo, hi)], k))
                own = sh[at[d] : at[d + 1]]
                if len(own):
                    size = 1 << int(len(own) - 1).bit_length()
                    by_size.setdefault(size, []).append((i + d, own))
        self.tables = []
        for size, rows in sorted(by_size.items()):
            values = np.array([[(own * m).min() for m in _MIX] for _, own in rows], U)
            owner = np.array([r for r, _ in rows])
            per_hash = []
            for c in range(HASHES):
                order = np.argsort(values[:, c], kind="stable")
                per_hash.append((values[order, c], owner[order]))
            self.tables.append((size, per_hash))


#: The tables of the latest slices that a worker has built.
_BUILT: dict[str, _Items] = {}


def _built(key: str, ids: list[int | None], texts: list[str | None], k: int) -> _Items:
    if key not in _BUILT:
        while len(_BUILT) > 3:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = _Items(ids, texts, k)
    return _BUILT[key]


def _candidates(items: _Items, sh: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) pairs with an equal MinHash value in some segment."""
    if not len(sh):
        return set()
    small, large = ([t for t in items.tables if (t[0] < SMALL) == is_small] for is_small in (True, False))
    return set().union(*(_met(tables, sh, at) for tables in (small, large) if tables))


def _met(tables: list, sh: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
    base = min(size for size, _ in tables)
    n = np.diff(at)
    blocks = -(-n // base)
    first = np.concatenate([[0], np.cumsum(blocks)])
    doc = np.repeat(np.arange(len(n)), blocks)
    inner = np.arange(first[-1]) - first[doc]
    cuts = at[doc] + inner * base
    found: set[tuple[int, int]] = set()
    for c in range(HASHES):
        low = np.minimum.reduceat(sh * _MIX[c], cuts)
        for size, per_hash in tables:
            values, owner = per_hash[c]
            level, width = low, 1
            while width < 2 * (size // base):  # segments of 2 * size shingles, cut off at the document's end
                other = level.copy()
                same = doc[width:] == doc[:-width]
                other[:-width] = np.where(same, np.minimum(level[:-width], level[width:]), level[:-width])
                level, width = other, 2 * width
            seg = np.flatnonzero(inner % (size // base) == 0)
            lo = np.searchsorted(values, level[seg])
            hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == level[seg])
            for x in hit:
                v = level[seg[x]]
                hi = lo[x]
                while hi < len(values) and values[hi] == v:
                    found.add((int(doc[seg[x]]), int(owner[hi])))
                    hi += 1
    return found


def _search(ids: list, texts: list, k: int, threshold: float):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(key, ids, texts, k)
        for batch in batches:
            rows, item, share = [], [], []
            for i, _, part, starts, stops, bounds, h in _words(batch.column("_text")):
                sh, at = shingles(h, bounds, k)
                pairs = _candidates(items, sh, at)
                if not pairs:
                    continue
                flat = part.tobytes()
                last, own = -1, set()
                for d, x in sorted(pairs):
                    if d != last:
                        lo, hi = int(bounds[d]), int(bounds[d + 1])
                        s, e = starts[lo:hi].tolist(), stops[lo:hi].tolist()
                        last, own = d, exact_shingles([flat[p:q] for p, q in zip(s, e, strict=True)], k)
                    want = items.sets[x]
                    got = len(want & own) / len(want)
                    if got >= threshold:
                        rows.append(i + d)
                        item.append(items.ids[x])
                        share.append(got)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows)), pa.array(item, pa.int64()), pa.array(share, pa.float64())], ["_id", "_item", "containment"])
        tidy()

    return run


def _slices(items: DataFrame, item_id: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Items in slices of a checked size, one at a time on the driver."""
    ids, texts, chars = [], [], 0
    for r in items.select(column(item_id).cast("long"), column(text_col)).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        chars += len(r[1] or "")
        if len(ids) >= SLICE_ITEMS or chars >= SLICE_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Each (document, item) with at least ``threshold`` of the item's shingles in the document."""
    arrow_session(docs.sparkSession)
    src = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"))
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, _item long, containment double"
    out = None
    for ids, texts in _slices(items, item_id, item_text):
        part = src.mapInArrow(_search(ids, texts, k, threshold), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.toDF(id_col, item_id if item_id != id_col else f"item_{item_id}", "containment")


def _drop(ids: list, texts: list, k: int, threshold: float):
    search = _search(ids, texts, k, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("_text")], ["_id", "_text"])
            bad = {x for found in search(iter([numbered])) for x in found.column("_id").to_pylist()}
            keep = np.array([i for i in range(batch.num_rows) if i not in bad], np.int64)
            yield batch.take(pa.array(keep)) if bad else batch
        tidy()

    return run


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that hold no item; all columns as they are."""
    arrow_session(docs.sparkSession)
    names = docs.columns
    out = numbered(docs)
    own = out.columns
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(own, docs.schema.fields, strict=True)) + ", _text string"
    for ids, texts in _slices(items, item_id, item_text):
        out = out.withColumn("_text", F.col(own[names.index(text_col)])).mapInArrow(_drop(ids, texts, k, threshold), schema).drop("_text")
    return out.toDF(*names)
