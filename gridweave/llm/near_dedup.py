"""Near-duplicate documents by DartMinHash signatures and a banded join.

A document is the weighted set of its ``k``-word shingles, the weight being how
often a shingle occurs.  An element's weight axis is cut into unit regions, and
each region throws darts: a Poisson process of ranks, from hashes of shingle and
region alone, so a region throws the same darts in every document that has it.
A dart counts where its place on the weight axis lies below the element's
weight.  All darts of rank up to ``(HASHES * ln(HASHES) + 2 * HASHES) / weight``
are thrown; each hits one of ``HASHES`` coordinates, and the earliest dart of a
coordinate is its value.  Where a coordinate stays empty the rank bound is
doubled.  Two values are equal with the weighted Jaccard similarity.

Equal texts are one node from the start.  Nodes with an equal band meet in a
bucket.  First one member leads each bucket, that which shares most with most
others, so that a group round one original is found at once: the members are
compared with it, exactly, by the shingles of both texts.  Where a bucket then
still holds several classes, all its members of different classes are compared:
each node lives in one block of bounded size, with others of its largest
bucket, and members that are not of a bucket's largest class visit the blocks
of the others.  Inside a block only pairs can be similar that share one of
their rarest shingles, so no pair is left out.  Similar nodes are joined to
classes by spreading the smallest label and jumping pointers.

A leader's text is sent to the members in as many copies as its members need
tasks, and what a step wrote to the shared folder goes with the next step.

Words are lower-cased runs of letters, digits and non-ASCII characters.
Defined results: texts of fewer than ``k`` words have one shingle, of all their
words; a text without words is like equal texts only; null counts as empty;
repeated rows get the same class; a class is named by its smallest id, null
where it has no id; an empty table gives no rows; a very long text is signed
and compared whole, in a chunk of its own; other columns, whatever their names,
are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import NON_WORD, U, arrow_session, chunks, column, cut, drop_cut, mix64, numbered, seeds, shingles, text_bytes, tidy, word_hashes, word_spans

BANDS = 32
ROWS = 6
HASHES = BANDS * ROWS
#: Shingles of the texts that live in a block, and of those that visit it at once.
BLOCK = 1 << 17
#: Shingles that are compared at once inside a block.
AT_ONCE = 1 << 20
#: Members of a bucket that meet one copy of their leader's text.
MEMBERS = 1 << 10
_GOLD = U(0x9E3779B97F4A7C15)
_STEP = seeds(1, 5)
_EMPTY = np.iinfo(np.uint64).max


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, hashes: int = HASHES) -> np.ndarray:
    """Signatures (sets x hashes) of weighted sets.

    ``elements`` are 64-bit hashes, each once in its set ``owner`` with a
    positive weight.  An empty set has the largest value everywhere.
    """
    regions = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), regions)
    nth = np.arange(regions.sum()) - np.repeat(np.cumsum(regions) - regions, regions)
    unit = mix64(elements[at] + nth.astype(U) * _GOLD)
    room = np.minimum(weights[at] - nth, 1.0)
    doc = owner[at]
    total = np.bincount(owner, weights, minlength=sets)
    out = np.full(sets * hashes, _EMPTY, U)
    bound = np.zeros(sets)
    some = total > 0
    bound[some] = (hashes * np.log(hashes) + 2 * hashes) / total[some]
    open_ = some.copy()
    while open_.any():
        use = np.flatnonzero(open_[doc])
        u, d, space = unit[use], doc[use], room[use]
        rank = np.zeros(len(use))
        salt = np.zeros(1, U)
        while len(u):
            salt = salt + _STEP
            x = mix64(u + salt)
            rank = rank - np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            go = rank <= bound[d]
            u, d, rank, space, x = u[go], d[go], rank[go], space[go], x[go]
            y = mix64(x ^ _GOLD)
            hit = ((y >> U(40)).astype(np.float64) * 2.0**-24) < space  # the dart's place on the weight axis
            coordinate = (y & U(0xFFFFFF)) % U(hashes)
            value = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (mix64(y) >> U(32))
            np.minimum.at(out, d[hit] * hashes + coordinate[hit].astype(np.int64), value[hit])
        open_ &= (out.reshape(sets, hashes) == _EMPTY).any(1)
        bound[open_] *= 2
    return out.reshape(sets, hashes)


def weighted_shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: shingle hashes, how often each occurs, and its text."""
    data, offsets = text_bytes(texts, lower=True)
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, stops, bounds = word_spans(part, offsets[i : j + 1] - offsets[i], NON_WORD)
        sh, at = shingles(word_hashes(part, starts, stops), bounds, k)
        doc = np.repeat(np.arange(j - i), np.diff(at))
        order = np.lexsort((sh, doc))
        sh, doc = sh[order], doc[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        yield i, j, sh[first], np.diff(np.concatenate([first, [len(sh)]])), doc[first]


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signatures.reshape(len(signatures), bands, -1)
    key = np.broadcast_to(seeds(bands, 3), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        key = mix64(key * _GOLD + parts[:, :, r])
    return key.view(np.int64)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sh, count, doc in weighted_shingles(batch.column("_text"), k):
                n = np.bincount(doc, count, minlength=j - i).astype(np.int64)
                keys = band_keys(dart_minhash(sh, count.astype(np.float64), doc, j - i))
                lens = np.where(n > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("node").slice(i, j - i), pa.array(n), bands], ["id", "node", "n", "bands"])
        tidy()

    return run


def _similar(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            sides = []
            for name in ("a", "b"):
                own: list[tuple[np.ndarray, np.ndarray]] = []
                for i, j, sh, count, doc in weighted_shingles(batch.column(name), k):
                    at = np.searchsorted(doc, np.arange(j - i + 1))
                    own += [(sh[at[x] : at[x + 1]], count[at[x] : at[x + 1]]) for x in range(j - i)]
                sides.append(own)
            for (x, n), (y, m) in zip(*sides, strict=True):
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                both = np.minimum(n, m[at])[y[at] == x].sum() if len(y) and len(x) else 0
                ok.append(bool(both >= threshold * (n.sum() + m.sum() - both) and both > 0))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("leader")], ["node", "leader"]).filter(pa.array(ok, pa.bool_()))
        tidy()

    return run


def text_node(text_col: str | Column) -> Column:
    """What equal texts share: 128 bits of the text (null: the empty text)."""
    c = column(text_col) if isinstance(text_col, str) else text_col
    return F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))


def _components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the edges; the label is the smallest node of the class."""
    both = cut(edges.select("node", "leader").unionByName(edges.select(F.col("leader").alias("node"), F.col("node").alias("leader"))))
    label = cut(both.groupBy("node").agg(F.least(F.min("leader"), F.first("node")).alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("leader"), F.col("label").alias("far")), "leader").groupBy("node").agg(F.min("far").alias("far"))
        step = label.join(near, "node", "left").select("node", "label", F.least("label", "far").alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("label").alias("next"))
        step = step.join(jump, "new", "left").select("node", "label", F.least("new", "next").alias("new"))
        step = cut(step)
        if step.filter(F.col("new") != F.col("label")).isEmpty():
            drop_cut(both, step)
            return label
        new = cut(step.select("node", F.col("new").alias("label")))
        drop_cut(label, step)
        label = new


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (node, leader) whose texts are similar.  A pair moves the text of its node; a leader's goes once for each ``MEMBERS`` of them."""
    pairs = cut(pairs)
    copies = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies"))
    copies = cut(copies)
    a = texts.select("node", F.col("_text").alias("a"))
    b = texts.select(F.col("node").alias("leader"), F.col("_text").alias("b")).join(copies, "leader").select("leader", "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(copies, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"))
    both = dealt.join(a, "node").join(b, ["leader", "copy"]).select("node", "leader", "a", "b")
    out = cut(both.mapInArrow(_similar(k, threshold), "node binary, leader binary"))
    drop_cut(pairs, copies)
    return out


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each class once ``a`` and ``b`` are joined."""
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root != root[root]).any():
            root = root[root]
    return root


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs whose sizes sum up to about ``limit``, a larger one alone."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
        yield i, j
        i = j


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start, start + 1, ... of each run of ``n``, and its number."""
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of], of


def _similar_classes(k: int, threshold: float):
    """Of the texts of a block: (node, leader), the labels of classes to be joined.

    Residents are compared with visitors, and with each other in the block's
    first chunk.  An element is a shingle and how often it came before; texts
    are similar only if they share one of their ``n - threshold * n + 1`` rarest.
    """

    def run(table: pa.Table) -> pa.Table:
        labels = pa.concat_arrays(table["label"].chunks).dictionary_encode()
        cls, rows = labels.indices.to_numpy(), len(table)
        visits, first = table["visits"].to_numpy().astype(bool), table["chunk"][0].as_py() == 0
        parts = []
        for i, _, sh, count, doc in weighted_shingles(table["_text"], k):
            nth, at = _spread(np.zeros(len(sh), np.int64), count)
            parts.append((mix64(sh[at] + nth.astype(U) * _GOLD), doc[at] + i))
        e, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = np.bincount(d, minlength=rows)
        start = np.cumsum(n) - n
        _, e, often = np.unique(e, return_inverse=True, return_counts=True)
        by_rarity = np.argsort(often, kind="stable")
        rank = np.empty(len(often), np.int64)
        rank[by_rarity] = np.arange(len(often))
        shared, e = often[by_rarity] > 1, rank[e]
        order = np.lexsort((e, d))
        e, d = e[order], d[order]
        code = d * len(often) + e
        rare = (np.arange(len(d)) - start[d] <= n[d] - np.ceil(threshold * n[d] - 1e-6)) & shared[e]
        home = np.flatnonzero(rare & ~visits[d])
        home = home[np.argsort(e[home], kind="stable")]
        asks = np.flatnonzero(rare & (visits[d] | first))
        low = np.searchsorted(e[home], e[asks], side="left")
        met = np.searchsorted(e[home], e[asks], side="right") - low
        root = np.arange(len(labels.dictionary))
        for i, j in _runs(met, AT_ONCE):
            at, of = _spread(low[i:j], met[i:j])
            u, v = d[asks[i:j][of]], d[home[at]]
            fit = (visits[u] | (v < u)) & (np.minimum(n[u], n[v]) >= np.maximum(n[u], n[v]) * threshold)
            u, v = np.divmod(np.unique((u * rows + v)[fit & (root[cls[u]] != root[cls[v]])]), rows)
            for x, y in _runs(n[u], AT_ONCE):
                a, b = u[x:y], v[x:y]
                open_ = root[cls[a]] != root[cls[b]]
                a, b = a[open_], b[open_]
                at, of = _spread(start[a], n[a])
                asked = b[of] * len(often) + e[at]
                hit = code[np.minimum(np.searchsorted(code, asked), len(code) - 1)] == asked
                both = np.bincount(of, hit, minlength=len(a))
                ok = both >= threshold * (n[a] + n[b] - both)
                root = _united(root, cls[a[ok]], cls[b[ok]])
        joined = np.flatnonzero(root != np.arange(len(root)))
        del parts, e, d, order, code
        tidy()
        return pa.table({"node": labels.dictionary.take(pa.array(joined)), "leader": labels.dictionary.take(pa.array(root[joined]))})

    return run


def _with_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows (key, node, size, ...) with what is known of their bucket; a large bucket's row goes to several tasks."""
    copies = F.ceil(F.col("size") / MEMBERS).cast("int")
    buckets = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("size")
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), copies).cast("int")).join(buckets, ["key", "salt"]).drop("salt")


def _left_apart(met: DataFrame, label: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame | None:
    """Links (node, leader) of all similar nodes that share a bucket and are of different classes."""
    rows = met.select("key", "node", "n", "size").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.first("size").alias("size")).filter("a != b").select("key", "size")
    rows = cut(_with_bucket(rows, several))
    largest = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    home = rows.groupBy("node").agg(F.max(F.struct("size", "key"))["key"].alias("home"), F.first("n").alias("n"), F.first("label").alias("label"))
    load = cut(home.groupBy("home").agg(F.sum("n").alias("load")))
    total = load.agg(F.sum("load")).first()[0]
    if not total:
        drop_cut(rows, load)
        return None
    piece = F.pmod(F.xxhash64("node"), F.ceil(F.col("load") / BLOCK))
    lives = cut(home.join(load, "home").select("node", "n", "label", F.pmod(F.xxhash64("home", piece), F.lit(total // BLOCK + 1)).alias("block")))
    there = cut(rows.select("key", "node", "label").join(lives.select("node", "n", "block"), "node").join(largest, "key").withColumn("main", F.col("label") == F.col("main")))
    blocks = there.groupBy("key", F.col("block").alias("to")).agg(F.max("main").alias("has_main"))
    # of two that are not of the main class one visits the other
    goes = (F.col("to") != F.col("block")) & (F.col("has_main") | (F.col("to") < F.col("block")))
    guests = there.filter("NOT main").join(blocks, "key").filter(goes).select("node", "n", "label", F.col("to").alias("block")).distinct()
    guests = visitors = cut(guests)
    chunks = guests.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK).alias("chunks"))
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1))
    residents = lives.join(chunks, "block", "left").select("node", "label", "block", nth.alias("chunk"), F.lit(False).alias("visits"))
    guests = guests.join(chunks, "block").select("node", "label", "block", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), F.lit(True).alias("visits"))
    both = residents.unionByName(guests).join(texts, "node").select("block", "chunk", "label", "visits", "_text")
    out = cut(both.groupBy("block", "chunk").applyInArrow(_similar_classes(k, threshold), "node binary, leader binary"))
    drop_cut(rows, load, lives, there, visitors)
    return out


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: its id, and the smallest id of its class."""
    arrow_session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(column(id_col).alias("id"), text_node(text_col).alias("node"), column(text_col).alias("_text"))
    signed = cut(src.mapInArrow(_signed(k), f"id {kind}, node binary, n long, bands array<long>"))
    nodes = signed.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    member = nodes.select("node", "rep", "n", F.explode("bands").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = cut(member.join(sizes, "key"))
    own = cut(signed.select("id", "node"))
    drop_cut(signed)

    # one text for each node that shares a bucket
    asked = met.select("node", "rep").distinct()
    texts = src.join(asked.hint("shuffle_hash"), (src["node"] == asked["node"]) & src["id"].eqNullSafe(asked["rep"])).select(src["node"], "_text")
    texts = cut(texts)
    repeated = not own.groupBy("id").count().filter("count > 1").isEmpty()
    one_each = texts.dropDuplicates(["node"]) if repeated else texts
    # the node that shares most buckets with most nodes leads: an original rather than one of its copies
    central = met.groupBy("node").agg(F.sum("size").alias("order"))
    ranked = met.select("key", "node", "n", "size").join(central, "node")
    top = F.max(F.struct("order", "node", "n"))
    first = ranked.groupBy("key").agg(top["node"].alias("leader"), top["n"].alias("m"), F.first("size").alias("size"))
    fits = (F.col("node") != F.col("leader")) & (F.least("n", "m") >= F.greatest("n", "m") * threshold)
    edges = _verified(_with_bucket(ranked, first).filter(fits).select("node", "leader").distinct(), one_each, k, threshold)
    label = _components(edges)
    more = _left_apart(met, label, one_each, k, threshold)
    drop_cut(met, texts)
    if more is not None:
        drop_cut(label)
        label = _components(edges.unionByName(more))
        drop_cut(more)
    drop_cut(edges)
    named = own.groupBy("node").agg(F.min("id").alias("rep")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = named.join(classes, "label").select("node", "class_id")
    return own.join(named, "node").select(F.col("id").alias(id_col), "class_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each class, that with the smallest id; all columns as they are.

    Of rows with the same id (null included) that stay, one is kept for each text.
    """
    names = docs.columns
    rows = numbered(docs)
    own, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    classes = near_duplicate_classes(rows.select(own, text), own, text, k, threshold)
    keep = classes.filter(F.col(own).eqNullSafe(F.col("class_id"))).select(F.col(own).alias("_keep")).distinct()
    kept = rows.join(keep.hint("shuffle_hash"), rows[own].eqNullSafe(F.col("_keep")), "left_semi")
    if not kept.groupBy(own).count().filter("count > 1").isEmpty():
        kept = kept.withColumn("_node", text_node(text)).dropDuplicates([own, "_node"]).drop("_node")
    return kept.toDF(*names)
