"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

For each pre-token the ranks of its adjacent pairs are the leaves of a segment
tree of minima.  A leaf is ``rank * leaves + position``, so the root is the
leftmost pair of the lowest rank.  A merge changes three leaves, each with one
update for each level, until the root is "no pair".  The trees of many
pre-tokens are worked on at once, one numpy row each; a very long pre-token
gets a tree of its own.

Pre-tokens never reach over a single space between two words, so what a worker
caches is whole words with the space before them.  A text where white space
follows a space is split by the pattern as a whole instead.

Defined results: a null text is encoded as the empty text, to no ids; special
tokens in a text become their ids, as the tokenizers library does by default;
truncation and padding are not used; of pairs with one rank the leftmost is
merged; repeated rows are each encoded; an empty table gives no rows; a text or
a pre-token of any length is encoded whole; other columns, whatever their
names, are not touched.  Vocabulary files of another kind are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_session, numbered, tidy

# The published split pattern of byte-level BPE.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words that a worker keeps; it starts anew when there are more.
CACHE_WORDS = 300_000
#: Leaves of all trees that are worked on at once.
TREE_CELLS = 1 << 20
#: Leaves from which a pre-token is merged alone, by the same tree in plain lists; ids do not depend on it.
LONG = 2048
_NONE = np.iinfo(np.int64).max
_AFTER_SPACE = re.compile(r" (?:\s|\Z)")


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Index(dict):
    """Numbers its keys in the order of their first use."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class _Ragged:
    """Growing lists of ids, by number."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.n, self.rows = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0

    def extend(self, flat: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(lens) > len(self.at):
            self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.zeros_like(self.n)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[self.rows : self.rows + len(lens)] = self.used + np.cumsum(lens) - lens
        self.n[self.rows : self.rows + len(lens)] = lens
        self.used += len(flat)
        self.rows += len(lens)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.n[rows].astype(np.int64)
        ends = np.cumsum(lens)
        where = np.repeat(self.at[rows] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[where], lens


def _supported(spec: dict, path: str) -> None:
    """Raises where a file asks for anything but plain byte-level BPE."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if spec["normalizer"] is not None or model["type"] != "BPE" or not plain:
        raise ValueError(f"{path}: only plain byte-level BPE without a normalizer is supported")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path}: the pre-tokenizer must be ByteLevel with its own pattern and no prefix space")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens must be plain")


class Tokenizer:
    """A byte-level BPE tokenizer read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _supported(spec, path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 20) | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        first = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])
        self.keys, self.order = self.keys[first], self.order[first]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.pattern = regex.compile(SPLIT)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.first, self.rest, self.tokens = _Index(), _Index(), _Index()
        self.first_ids, self.rest_ids, self.token_ids = _Ragged(), _Ragged(), _Ragged()

    # -- merging ------------------------------------------------------------

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is not mergeable."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pre-token (flat), and how many each has."""
        lens = np.array([len(w) for w in words], np.int64)
        flat = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(lens) - lens
        out = np.zeros(len(flat), np.int32)
        count = lens.copy()
        leaves = np.ones(len(words), np.int64)
        while (short := leaves < lens - 1).any():
            leaves[short] *= 2
        done: dict[int, np.ndarray] = {}
        for size in np.unique(leaves):
            rows = np.flatnonzero((leaves == size) & (lens > 0))
            if size >= LONG:
                for r in rows:
                    done[int(r)] = ids = self._merge_long(flat[starts[r] : starts[r] + lens[r]].tolist(), int(size))
                    count[r] = len(ids)
                continue
            step = max(1, TREE_CELLS // int(size))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                sym, alive = self._merge_rows(flat, starts[some], lens[some], int(size))
                count[some] = alive.sum(1)
                ends = np.repeat(starts[some], count[some]) + np.concatenate([np.arange(c) for c in count[some]]) if len(some) else []
                out[ends] = sym[alive]
        for r, ids in done.items():
            out[starts[r] : starts[r] + len(ids)] = ids
        keep = np.arange(len(flat)) - np.repeat(starts, lens) < np.repeat(count, lens)
        return out[keep], count

    def _merge_rows(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(starts), size + 1
        place = np.arange(width)
        alive = place[None, :] < lens[:, None]
        sym = np.where(alive, flat[np.minimum(starts[:, None] + place, len(flat) - 1)], -1)
        after = np.where(place[None, :] + 1 < lens[:, None], place[None, :] + 1, -1)
        before = np.repeat(place[None, :] - 1, n, 0)
        tree = np.full((n, 2 * size), _NONE, np.int64)
        has = after[:, :size] >= 0
        r = self.rank(sym[:, :size][has], sym[:, 1:][has])
        leaf = np.full((n, size), _NONE, np.int64)
        leaf[has] = np.where(r >= 0, r * size + np.broadcast_to(place[:size], (n, size))[has], _NONE)
        tree[:, size:] = leaf
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1 if size > 1 else 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            rank, i = root // size, root % size
            j = after[live, i]
            k = after[live, j]
            p = before[live, i]
            new = self.merged[rank]
            sym[live, i] = new
            alive[live, j] = False
            after[live, i] = k
            more = k >= 0
            before[live[more], k[more]] = i[more]
            self._update(tree, live, j, np.full(len(live), _NONE), size, j < size)
            value = np.full(len(live), _NONE)
            r = self.rank(new[more], sym[live[more], k[more]])
            value[more] = np.where(r >= 0, r * size + i[more], _NONE)
            self._update(tree, live, i, value, size, np.ones(len(live), bool))
            more = p >= 0
            r = self.rank(sym[live[more], p[more]], new[more])
            value = np.full(len(live), _NONE)
            value[more] = np.where(r >= 0, r * size + p[more], _NONE)
            self._update(tree, live, p, value, size, more)
            live = live[tree[live, 1] < _NONE]
        return sym, alive

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, size: int, which: np.ndarray) -> None:
        rows, node = rows[which], leaf[which] + size
        tree[rows, node] = value[which]
        while size > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            size >>= 1

    def _merge_long(self, sym: list[int], size: int) -> list[int]:
        n = len(sym)
        table = self._table()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        none = 1 << 62
        tree = [none] * (2 * size)

        def leaf(i: int) -> int:
            j = after[i]
            r = table.get((sym[i] << 20) | sym[j]) if j >= 0 else None
            return none if r is None else r * size + i

        for i in range(n - 1):
            tree[size + i] = leaf(i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            node >>= 1
            while node:
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    return
                tree[node] = value
                node >>= 1

        merged = self.merged
        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            k = after[j]
            sym[i] = int(merged[rank])
            after[i] = k
            if k >= 0:
                before[k] = i
            if j < size:
                put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i >= 0:
            out.append(sym[i])
            i = after[i]
        return out

    def _table(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), self.order.tolist(), strict=True))
        return self._pairs

    # -- texts --------------------------------------------------------------

    def _learn(self, index: _Index, ids: _Ragged, prefix: str) -> None:
        """Encodes the words that ``index`` has got since the last call."""
        if not index.new:
            return
        split = [self.pattern.findall(prefix + w) for w in index.new]
        index.new = []
        rows = np.fromiter((self.tokens[t] for s in split for t in s), np.int64)
        self._learn_tokens()
        flat, lens = self.token_ids.take(rows)
        per = np.array([len(s) for s in split], np.int64)
        total = np.concatenate([[0], np.cumsum(lens)])
        bounds = np.concatenate([[0], np.cumsum(per)])
        ids.extend(flat, np.diff(total[bounds]))

    def _learn_tokens(self) -> None:
        if self.tokens.new:
            self.token_ids.extend(*self.merge([t.encode() for t in self.tokens.new]))
            self.tokens.new = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text in them."""
        if len(self.first) + len(self.rest) + len(self.tokens) > CACHE_WORDS:
            self.forget()
        # rows of what a piece is made of: kind 0 first word, 1 later words, 2 pre-tokens, 3 a special id
        pieces: list[tuple[int, int, np.ndarray]] = []
        for d, text in enumerate(texts):
            if not text:
                continue
            for part in self.cut_special.split(text) if self.cut_special and any(s in text for s in self.special) else (text,):
                if part in self.special:
                    pieces.append((d, 3, np.array([self.special[part]])))
                elif _AFTER_SPACE.search(part):
                    pieces.append((d, 2, np.fromiter(map(self.tokens.__getitem__, self.pattern.findall(part)), np.int64)))
                elif part:
                    head, *words = part.split(" ")
                    pieces.append((d, 0, np.array([self.first[head]])))
                    pieces.append((d, 1, np.fromiter(map(self.rest.__getitem__, words), np.int64, len(words))))
        self._learn(self.first, self.first_ids, "")
        self._learn(self.rest, self.rest_ids, " ")
        self._learn_tokens()
        ids = (self.first_ids, self.rest_ids, self.token_ids)
        out, count = [], np.zeros(len(texts), np.int64)
        for d, kind, rows in pieces:
            got = rows.astype(np.int32) if kind == 3 else ids[kind].take(rows)[0]
            out.append(got)
            count[d] += len(got)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(count)])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, once for each worker."""
    return Tokenizer(path)


#: Texts that are encoded at once.
TEXTS = 256


def _encoded(path: str, keep: list[str], with_ids: bool, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                ids, bounds = tok.encode(part.column("_text").to_pylist())
                cols = [part.column(c) for c in keep] + [pa.array(np.diff(bounds))]
                names = [*keep, "n_tokens"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                if digests:
                    of_ids, of_text = [], []
                    b = bounds.tolist()
                    for lo, hi in zip(b[:-1], b[1:], strict=True):
                        own = ids[lo:hi].tolist()
                        of_ids.append(hashlib.sha256(",".join(map(tok.decimal.__getitem__, own)).encode()).hexdigest())
                        of_text.append(hashlib.sha256(tok.decode(own).encode()).hexdigest())
                    cols += [pa.array(of_ids), pa.array(of_text)]
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols, names)
        tidy()

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """Columns ``keep`` with n_tokens and, as asked, ids and the digests of ids and decoded text.

    An encoded row depends on nothing but its own text, so there is no shuffle
    and a lost task is just run again.
    """
    arrow_session(docs.sparkSession)
    at = [docs.columns.index(n) for n in keep] if keep is not None else range(len(docs.columns))
    own = [f"_c{i}" for i in at]
    src = numbered(docs).select(*own, F.col(f"_c{docs.columns.index(text_col)}").alias("_text"))
    schema = ", ".join(f"_c{i} {docs.schema[i].dataType.simpleString()}" for i in at)
    schema += ", " * bool(own) + "n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    out = src.mapInArrow(_encoded(path, own, ids, digests), schema)
    return out.toDF(*[docs.columns[i] for i in at], *out.columns[len(own) :])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The frame with a column ``decoded``: the text of its ids (null: empty)."""
    names = encoded.columns
    src = numbered(encoded)
    at = f"_c{names.index(ids_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            texts = [tok.decode(x or []) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(src.columns, encoded.schema.fields, strict=True))
    return src.mapInArrow(run, f"{schema}, decoded string").toDF(*names, "decoded")
