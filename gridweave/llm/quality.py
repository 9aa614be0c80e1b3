"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins.  Training goes round the features:
each step fits a shallow tree (up to four leaves) to the gradient over the bins
of one feature and adds a fraction of it to that feature's lookup table.  Then
the ``PAIRS`` pairs of features with the largest gain on what is left get
two-dimensional tables the same way.  A score is the logistic function of a sum
of table entries, looked up for all documents of a batch at once.

Features come from the text alone.  The model is fitted on the driver from a
bounded sample of labelled rows: ``TRAIN_ROWS`` of them, by hashes of the ids,
and never more than twice as many; only their features and labels come to the
driver.

Defined results: a null text is the empty text and has a score like any other;
labels other than 0 and 1 are not used; of labels that differ for one id the
larger counts; without labels every score is 0.5; repeated rows get the same
score; an empty table gives no rows; a very long text is scored whole, in a
chunk of its own; columns are told apart by place, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, arrow_session, chunks, column, crc_mod, numbered, share_of, text_bytes, tidy, word_hashes, word_spans

TRAIN_ROWS = 12_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
RATE = 0.15
#: Added to the second derivative of a leaf.
RIDGE = 5.0

_UPPER, _LOWER, _DIGIT, _BLANK, _LINE, _STOP, _MARK, _BAR, _HIGH, _REST = range(10)
_CLASS = np.full(256, _REST, np.uint8)
for _chars, _c in ((range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT), (b" \t", _BLANK), (b"\n\r", _LINE), (b".,;:?'\"-()", _STOP), (b"!", _MARK), (b"|<>{}[]\\/_=", _BAR), (range(128, 256), _HIGH)):
    _CLASS[list(_chars)] = _c

FEATURES = [
    "log_bytes", "log_words", "upper", "lower", "digit", "blank", "line", "stop", "mark", "bar", "non_ascii", "other",
    "word_length", "word_spread", "short_words", "long_words", "upper_words", "capital_words", "odd_ends",
    "distinct_words", "top_word", "line_words", "distinct_lines",
]


def _per(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, minlength=n)


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and how often its most frequent one occurs."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.concatenate([first, [len(h)]]))
    top = np.zeros(n)
    np.maximum.at(top, owner[first], runs)
    return np.bincount(owner[first], minlength=n), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    data, offsets = text_bytes(texts)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    line = np.zeros(256, bool)
    line[[10, 13]] = True
    for i, j in chunks(offsets):
        part, off, n = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], j - i
        size = np.diff(off)
        kinds = np.bincount(np.repeat(np.arange(n), size) * 10 + _CLASS[part], minlength=n * 10).reshape(n, 10)
        starts, stops, bounds = word_spans(part, off, SPACE)
        words = np.diff(bounds)
        owner = np.repeat(np.arange(n), words)
        lens = (stops - starts).astype(float)
        some, w = np.maximum(size, 1), np.maximum(words, 1)
        first, last = _CLASS[part[starts]], _CLASS[part[stops - 1]]
        second = _CLASS[part[np.minimum(starts + 1, stops - 1)]]
        distinct, top = _distinct(word_hashes(part, starts, stops), owner, n)
        l0, l1, lb = word_spans(part, off, line)
        lines = np.diff(lb)
        distinct_lines, _ = _distinct(word_hashes(part, l0, l1), np.repeat(np.arange(n), lines), n)
        mean = _per(lens, owner, n) / w
        x = out[i:j]
        x[:, 0], x[:, 1] = np.log1p(size), np.log1p(words)
        x[:, 2:12] = kinds / some[:, None]
        x[:, 12] = mean
        x[:, 13] = np.sqrt(np.maximum(_per(lens * lens, owner, n) / w - mean * mean, 0))
        x[:, 14], x[:, 15] = _per(lens <= 3, owner, n) / w, _per(lens >= 15, owner, n) / w
        x[:, 16] = _per((first == _UPPER) & (second == _UPPER), owner, n) / w
        x[:, 17] = _per(first == _UPPER, owner, n) / w
        x[:, 18] = _per((last == _REST) | (last == _MARK) | (last == _BAR), owner, n) / w
        x[:, 19], x[:, 20] = distinct / w, top / w
        x[:, 21], x[:, 22] = words / np.maximum(lines, 1), distinct_lines / np.maximum(lines, 1)
    return out


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over bins of a tree that is fitted to gradient sums g and curvature sums h."""
    n = len(g)
    if depth == 0 or n == 1:
        return np.full(n, g.sum() / (h.sum() + RIDGE))
    gs, hs = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gs**2 / (hs + RIDGE) + (g.sum() - gs) ** 2 / (h.sum() - hs + RIDGE)
    cut = int(gain.argmax()) + 1
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values and gain of the best tree that cuts a grid once along each axis."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    g1, h1 = gc[:-1, :-1], hc[:-1, :-1]
    gr, hr, gb, hb = gc[:-1, -1:], hc[:-1, -1:], gc[-1:, :-1], hc[-1:, :-1]
    parts = [(g1, h1), (gr - g1, hr - h1), (gb - g1, hb - h1), (gc[-1, -1] - gr - gb + g1, hc[-1, -1] - hr - hb + h1)]
    for a, b in parts:
        total += a**2 / (b + RIDGE)
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    leaf = [a[i, j] / (b[i, j] + RIDGE) for a, b in parts]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(total.max())


@dataclass
class Model:
    """Bin edges, lookup tables of features and of pairs, and the base score."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, f], side="right")]
        for a, b, table in self.pairs:
            out += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-out))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single features, then of the best pairs."""
    n = x.shape[1]
    if not len(y):
        return Model([np.zeros(0)] * n, [np.zeros(0)] * n, [np.zeros(1)] * n, [], 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges, pair_edges = [_cuts(x[:, f], BINS) for f in range(n)], [_cuts(x[:, f], PAIR_BINS) for f in range(n)]
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(n)]
    coarse = [np.searchsorted(pair_edges[f], x[:, f], side="right") for f in range(n)]
    tables = [np.zeros(len(edges[f]) + 1) for f in range(n)]
    z = np.full(len(y), base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(n):
            if len(edges[f]):
                g, h = slope()
                step = RATE * _tree(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])))
                tables[f] += step
                z += step[bins[f]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        wide = len(pair_edges[b]) + 1
        return np.bincount(coarse[a] * wide + coarse[b], v, (len(pair_edges[a]) + 1) * wide).reshape(-1, wide)

    g, h = slope()
    gains = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(n) for b in range(a) if len(pair_edges[a]) and len(pair_edges[b])), reverse=True)
    pairs = [(a, b, np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1))) for _, a, b in gains[:PAIRS]]
    for _ in range(ROUNDS // 4):
        for a, b, table in pairs:
            g, h = slope()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[0]
            table += step
            z += step[coarse[a], coarse[b]]
    return Model(edges, pair_edges, tables, pairs, base)


def _featured(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("_text"))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), rows], [*keep, "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learns from about ``rows`` labelled documents whose crc32(id) mod 3 is not 1."""
    arrow_session(docs.sparkSession)
    known = labels.filter((crc_mod(column(id_col)) != 1) & column(label_col).isin(0, 1)).groupBy(column(id_col).alias("_id")).agg(F.max(column(label_col)).cast("int").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    known = known.filter(share_of(F.xxhash64(F.lit(3), F.col("_id")), share))
    # about ``rows`` pairs of numbers
    src = docs.select(column(id_col).alias("_doc"), column(text_col).alias("_text"))
    some = src.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("_text", "y", F.xxhash64("_text").alias("o"))
    # the bound holds also where many rows share an id
    got = some.mapInArrow(_featured(["y", "o"]), "y int, o long, x array<double>").orderBy("o", "y").limit(2 * rows).collect()
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    return train(x, np.array([r["y"] for r in got], float))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with score (0 to 1) and predicted (1 from 0.5)."""
    arrow_session(docs.sparkSession)
    at = [docs.columns.index(n) for n in keep] if keep is not None else range(len(docs.columns))
    own = [f"_c{i}" for i in at]
    src = numbered(docs).select(*own, F.col(f"_c{docs.columns.index(text_col)}").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*own, "score", "predicted"])
        tidy()

    schema = ", ".join(f"_c{i} {docs.schema[i].dataType.simpleString()}" for i in at)
    out = src.mapInArrow(run, f"{schema}{', ' if own else ''}score double, predicted int")
    return out.toDF(*[docs.columns[i] for i in at], "score", "predicted")
