"""Token-id files: an adaptive context-mixing range coder in reset blocks.

File format (little-endian).  A shard is ``MAGIC``, then the start model, then
blocks, then the document index, then the block table, then a trailer.

* The start model says what every block begins with: the shard's ids from
  frequent to rare, what follows the most frequent of them how often (order 1),
  and how often what no row of those holds occurs (order 0).
* A block codes up to ``BLOCK`` ids and depends on nothing but itself and the
  start model: models and coder are reset at its start.  Its table entry holds
  byte offset, byte length, number of ids, and the crc32 of the ids.
* The document index holds doc_id, null flag and number of ids per document.
* The trailer holds the places of the tables, the number of ids, and the crc32
  of start model and tables.

Model.  A slot for each pair of ids holds what followed the pair last in this
block (order 2).  The chance that it follows again is mixed from three: that of
slots with such a run of hits, that of order 1, and that of order 0.  They are
added as logits with weights that follow the errors made, one set of weights
for each length of run.  An id that order 2 misses has the share of the order-1
row, without what was just excluded; an adaptive bit model mixes order 1 with
what is left for order 0, whose classes of ids have counts that adapt every
``REFRESH`` ids.  So each id gets one cumulative interval, which a carry-free
range coder narrows; it emits 32-bit words.

Many blocks of a shard are coded together, one numpy lane each, in integers.

Defined results: a null text is encoded as the empty text, and still gets the
end id; documents go in ascending id order, null ids first, equal ids in the
order of the input's partitions; an empty table makes no shard and no rows; a
text of any length lies in one shard; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import SPACE, arrow_session, chunks, column, cut, input_bytes, mix64, seeds, shared_dir, text_bytes, tidy, word_spans
from .bpe import _Ragged, byte_characters

MAGIC = b"GWTOK3\0\0"
#: Ids of a block.
BLOCK = 1024
#: Blocks that are coded at once.
LANES = 8192
#: Ids between two refreshes of the order-0 counts.
REFRESH = 512
#: Slots of the order-2 context table.
SLOTS = 256
#: Ids, the most frequent ones, that have a row of followers.
ROWS = 1024
#: Pairs of ids that occur less often are left to order 0.
LEAST_PAIRS = 3
#: Bytes of input for each shard, about.
SHARD_BYTES = 16 << 20
#: Words that a worker keeps the ids of.
CACHE_WORDS = 2_000_000

_U = np.uint64
_TOP = _U(1 << 32)
_TRAILER = struct.Struct("<QQQQQQI")
_DOC = np.dtype([("doc_id", "<i8"), ("null", "<i4"), ("n", "<i4")])
_ENTRY = np.dtype([("at", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("crc", "<u4")])
_CLASSES = 256  # of ids, under order 0
_CLASS_ALL, _ID_ALL = 1024, 1024  # what the counts of classes, and of the ids of a class, sum up to
_ROW_ALL = 4096
_RUNS = 8  # lengths of runs of hits
_MOST_IDS = 130_000
_SLOT_BITS = 20  # of an entry that hold the id; the rest is its run
# logits of k / 4096, times 256, and back to chances of 65536
_LOGIT = np.rint(256 * np.log(np.clip(np.arange(4097), 0.5, 4095.5) / np.clip(4096 - np.arange(4097), 0.5, 4095.5))).astype(np.int32)
_CHANCE = np.clip(np.rint(65536 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 256, 65536 - 512).astype(np.int32)
# by the width of an order-1 part that is excluded: one over what is left, a little less, so that no rounding leads past a range
_PARTS = (1 - 2.0**-50) / np.maximum(_ROW_ALL - np.arange(_ROW_ALL + 1), 1)


class StartModel:
    """What every block of a shard begins with."""

    def __init__(self, alphabet: np.ndarray, class_size: np.ndarray, class_count: np.ndarray, share: np.ndarray, followers: np.ndarray, follower: np.ndarray, often: np.ndarray) -> None:
        self.parts = (alphabet, class_size, class_count, share, followers, follower, often)
        self.alphabet = alphabet
        n, k = len(alphabet), len(followers)
        self.n, self.k = n, k
        # order 0: class of each id, its share of the class, and where that share begins
        self.cls = np.repeat(np.arange(_CLASSES), class_size)
        self.first = np.cumsum(class_size) - class_size
        self.share = share.astype(np.int64)
        ends = np.cumsum(self.share)
        self.has = np.cumsum(class_size > 0) - 1  # shares of a class that has ids sum up to _ID_ALL
        self.begin = ends - self.share - self.has[self.cls] * _ID_ALL
        self.class_count = class_count.astype(np.int64)
        total = max(1, int(self.class_count.sum()))
        chance = self.share * self.class_count[self.cls] * 4096 // (total * _ID_ALL) if n else self.share
        self.logit0 = _LOGIT[np.clip(chance, 1, 4095)]
        # order 1: dense tables; row and column k are empty and stand for all rarer ids
        row = np.repeat(np.arange(k), followers)
        at = row * (k + 1) + follower
        # where a follower's part of the row begins << 16 | how wide it is
        self.cell = np.zeros((k + 1) * (k + 1), np.int32)
        some = np.cumsum(followers > 0) - 1
        self.cell[at] = (np.cumsum(often.astype(np.int64)) - often - some[row] * _ROW_ALL) << 16 | often
        self.filled = np.concatenate([followers > 0, [False]])

    def decoding(self) -> None:
        """Tables from a place in a row, or in a class, to the id."""
        _, _, _, _, followers, follower, often = self.parts
        self.row_at = np.concatenate([np.cumsum(followers > 0) - 1, [0]]) * _ROW_ALL
        self.row_at[~self.filled] = 0
        self.in_row = np.repeat(follower, often)
        if not len(self.in_row):
            self.in_row = np.zeros(_ROW_ALL, np.uint16)
        self.in_class = np.repeat(np.arange(self.n), self.share)

    def to_bytes(self) -> bytes:
        kinds = ("<u4", "<u4", "<u4", "<u2", "<u2", "<u2", "<u2")
        raw = b"".join(p.astype(t).tobytes() for p, t in zip(self.parts, kinds, strict=True))
        alphabet, _, _, _, followers, follower, _ = self.parts
        return struct.pack("<III", len(alphabet), len(followers), len(follower)) + zlib.compress(raw, 4)

    @staticmethod
    def from_bytes(data: bytes) -> StartModel:
        n, k, pairs = struct.unpack_from("<III", data)
        raw, at, parts = zlib.decompress(data[12:]), 0, []
        for kind, size in (("<u4", n), ("<u4", _CLASSES), ("<u4", _CLASSES), ("<u2", n), ("<u2", k), ("<u2", pairs), ("<u2", pairs)):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += parts[-1].nbytes
        return StartModel(*parts)


def _shares(weight: np.ndarray, group: np.ndarray, groups: int, whole: int) -> np.ndarray:
    """Integers of at least 1 near the weights, which sum up to ``whole`` in each group that has any."""
    size, total = np.bincount(group, minlength=groups), np.bincount(group, weight, minlength=groups)
    out = 1 + np.floor(weight * ((whole - size) / np.maximum(total, 1e-9))[group]).astype(np.int64)
    rest = whole - np.bincount(group, out, minlength=groups).astype(np.int64)
    heaviest = np.lexsort((weight, group))[np.cumsum(size)[size > 0] - 1]
    out[heaviest] += rest[size > 0]
    return out


def start_model(ids: np.ndarray, block: int = BLOCK) -> tuple[StartModel, np.ndarray]:
    """The start model of a shard's ids, and the ids as ranks of its alphabet."""
    if not len(ids):
        none = np.zeros(0, np.uint32)
        return StartModel(none, np.zeros(_CLASSES, np.uint32), np.zeros(_CLASSES, np.uint32), none, none, none, none), np.zeros(0, np.int64)
    if ids.max() < 1 << 22:
        count = np.bincount(ids)
        alphabet = np.flatnonzero(count)
        count = count[alphabet]
    else:
        alphabet, count = np.unique(ids, return_counts=True)
    if len(alphabet) > _MOST_IDS:
        raise ValueError(f"a shard of {len(alphabet)} different ids; {_MOST_IDS} is the most")
    order = np.argsort(-count, kind="stable")
    alphabet, count = alphabet[order], count[order]
    if alphabet.max() < 1 << 22:
        rank_of = np.zeros(int(alphabet.max()) + 1, np.int32)
        rank_of[alphabet] = np.arange(len(alphabet))
        ranks = rank_of[ids]
    else:
        by_id = np.argsort(alphabet)
        ranks = by_id[np.searchsorted(alphabet[by_id], ids)].astype(np.int32)
    n, k = len(alphabet), min(ROWS, len(alphabet))
    pairs = np.zeros((k + 1) * (k + 1), np.int32)
    step = block * max(1, (1 << 20) // block)
    for i in range(0, len(ranks), step):
        x = np.minimum(ranks[i : i + step], k)
        a = np.zeros_like(x)
        a[1:] = x[:-1]
        a[::block] = 0
        pairs += np.bincount(a * (k + 1) + x, minlength=len(pairs)).astype(np.int32)
    pairs = pairs.reshape(k + 1, k + 1)
    total = pairs.sum(1, dtype=np.int64)
    keep = pairs >= np.maximum(LEAST_PAIRS, total // (2 * _ROW_ALL))[:, None]
    keep[k], keep[:, k] = False, False
    row, follower = np.nonzero(keep)
    often = _shares(pairs[row, follower].astype(float), row, k, _ROW_ALL)
    left = count.astype(float)
    left[:k] = np.where(keep, 0, pairs).sum(0)[:k]
    # classes of about equal weight, none with too many ids
    weight = (left + 0.25) / (left.sum() + 0.25 * n) + 1 / n
    cls = np.minimum((np.cumsum(weight) - weight) * (_CLASSES / 2), _CLASSES - 1).astype(np.int64)
    share = _shares(left + 0.25, cls, _CLASSES, _ID_ALL)
    mass = np.bincount(cls, left + 0.25, minlength=_CLASSES)
    class_count = np.where(mass > 0, 1 + np.floor(mass * (4 * _CLASSES / mass.sum())), 0)
    followers = np.bincount(row, minlength=k)
    return StartModel(alphabet, np.bincount(cls, minlength=_CLASSES), class_count, share, followers, follower, often), ranks


class _Lanes:
    """Adaptive models of the blocks that are coded together; tables are flat, a lane after the other."""

    def __init__(self, start: StartModel, lanes: int, decodes: bool = False) -> None:
        rows = np.arange(lanes, dtype=np.int64)
        self.start, self.decodes, self.wide = start, decodes, start.k + 1
        self.at_slot, self.at_run = rows * SLOTS, rows * _RUNS
        self.at_class, self.at_cum, self.at_place = rows * _CLASSES, rows * (_CLASSES + 1), rows * _CLASS_ALL
        self.entry = np.zeros(lanes * SLOTS, np.int32)  # run << _SLOT_BITS | the id that it predicts
        self.chance = np.tile(np.linspace(0.1, 0.9, _RUNS) * 65536, lanes).astype(np.int32)
        self.w = np.repeat(np.array([[26000], [26000], [4000]], np.int32), lanes, 1)  # of orders 2, 1 and 0
        self.row = np.full(lanes, 3500, np.int32)
        self.counts = np.tile(start.class_count.astype(np.int32), (lanes, 1))
        self.refresh([])

    def refresh(self, seen: list[np.ndarray]) -> None:
        """Order-0 chances of the classes; ``seen`` are the cells of those coded since the last time."""
        if seen:
            self.counts += 4 * np.bincount(np.concatenate(seen), minlength=self.counts.size).astype(np.int32).reshape(self.counts.shape)
            seen.clear()
        total = np.maximum(self.counts.sum(1, keepdims=True), 1)
        freq = 1 + (self.counts * ((_CLASS_ALL - _CLASSES) / total).astype(np.float32)).astype(np.int32)
        freq[:, 0] += _CLASS_ALL - freq.sum(1)
        cum = np.zeros((len(freq), _CLASSES + 1), np.int32)
        np.cumsum(freq, 1, out=cum[:, 1:])
        self.cum = cum.ravel()
        self.place = np.repeat(np.tile(np.arange(_CLASSES, dtype=np.uint8), len(freq)), freq.ravel()) if self.decodes else None

    def between(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Width and begin of classes."""
        begin = _take(self.cum, at)
        return _take(self.cum, at + 1) - begin, begin

    def predict(self, row: np.ndarray, slot: np.ndarray) -> None:
        """Mixes the chance of what order 2 predicts; ``row`` is where the last id's row of cells begins."""
        n, s = len(row), self.start
        self.slot = slot + self.at_slot[:n]
        e = _take(self.entry, self.slot)
        self.run, self.guess = e >> _SLOT_BITS, e & ((1 << _SLOT_BITS) - 1)
        self.j = self.run + self.at_run[:n]
        out = _take(s.cell, row + np.minimum(self.guess, s.k))
        self.out_cum, self.out_freq = out >> 16, out & 0xFFFF
        self.c2 = _take(self.chance, self.j)
        self.logit = np.empty((3, n), np.int32)
        for i, (table, at) in enumerate(((_LOGIT, self.c2 >> 4), (_LOGIT, self.out_freq), (s.logit0, self.guess))):
            table.take(at, None, self.logit[i], "clip")
        dot = self.w[:, :n] * self.logit
        dot[0] += dot[1]
        dot[0] += dot[2]
        dot = dot[0] >> 16
        dot += 2048
        self.p = _take(_CHANCE, dot)
        self.q = self.row[:n]
        self.one = (65536 - self.p) * self.q >> 12

    def parts(self, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a 65536th of each range: how much; and where the parts of order 2 and of order 1 end, which begin at 0."""
        unit = rng >> _U(16)
        two = unit * self.p.astype(_U)
        return unit, two, two + unit * self.one.astype(_U)

    def divided(self, unit: np.ndarray, two: np.ndarray, one: np.ndarray, hits: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of each id begins, and the unit that it is divided into."""
        lo, r = two.copy(), one - two
        out = (r.astype(np.float64) * _take(_PARTS, self.out_freq)).astype(_U)
        lo[hits], out[hits] = 0, _take(two, hits)
        end = _take(one, rest)
        lo[rest], out[rest] = end, ((_take(unit, rest) << _U(16)) - end) // _U(_CLASS_ALL * _ID_ALL)
        return lo, out

    def update(self, x: np.ndarray, hits: np.ndarray, rest: np.ndarray) -> None:
        error = -self.p
        error[hits] += 65536
        c2 = self.c2 - ((self.c2 + 15) >> 4)
        old = _take(self.c2, hits)
        c2[hits] = old + ((65535 - old) >> 4)
        self.chance[self.j] = c2
        self.logit *= error
        self.logit >>= 15
        self.w[:, : len(x)] += self.logit
        q = (3968 - self.q) >> 5
        q[hits], q[rest] = 0, (128 - _take(self.q, rest)) >> 5
        self.q += q
        x = x + (1 << _SLOT_BITS)
        x[hits] += np.minimum(_take(self.run, hits), _RUNS - 2) << _SLOT_BITS
        self.entry[self.slot] = x


def _take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``take`` of places that exist, without its slow look at each; damaged codes may lead past the end."""
    return table.take(at, None, None, "clip")


_RANKS = np.arange(_MOST_IDS + 1, dtype=np.int64)
_HASH1 = ((_RANKS * 0x85EBCA6B >> 7) % SLOTS).astype(np.int64)
_HASH2 = ((_RANKS * 0xC2B2AE35 >> 11) % SLOTS).astype(np.int64)


def _layout(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks from long to short, and how many are active at each step."""
    order = np.argsort(-lens, kind="stable")
    sorted_ = lens[order]
    return order, np.searchsorted(-sorted_, -np.arange(int(sorted_[0]) if len(lens) else 0), side="left")


def _settle(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes with less than 32 bits of range left, and the words that they give out.

    Where the word is not settled yet the range is cut until it is.
    """
    at = np.flatnonzero(rng < _TOP)
    lo, r = _take(low, at), _take(rng, at)
    rng[at] = np.where((lo ^ (lo + r)) < _TOP, r, (~lo + _U(1)) & (_TOP - _U(1))) << _U(32)
    low[at] = lo << _U(32)
    return at, lo >> _U(32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[StartModel, list[tuple[bytes, int, int]]]:
    """The start model, and (code, number of ids, crc32 of the ids) of each block."""
    start, ranks = start_model(ids, block)
    out: list[tuple[bytes, int, int]] = []
    step = block * LANES
    for i in range(0, len(ids), step):
        out += _encode_lanes(start, ids[i : i + step], ranks[i : i + step], block)
    return start, out


def _encode_lanes(start: StartModel, ids: np.ndarray, ranks: np.ndarray, block: int) -> list[tuple[bytes, int, int]]:
    starts = np.arange(0, len(ids), block)
    lens = np.minimum(len(ids) - starts, block)  # only the last is shorter
    lanes, steps = len(starts), int(lens[0])
    grid = np.zeros((lanes, steps), np.int32)
    grid.ravel()[: len(ids)] = ranks
    grid = np.ascontiguousarray(grid.T)
    seen: list[np.ndarray] = []
    m, wide = _Lanes(start, lanes), start.k + 1
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    room = steps + 8
    code, size = np.zeros(lanes * room, np.uint32), np.arange(lanes, dtype=np.int64) * room
    a = b = row = np.zeros(lanes, np.int64)
    for t in range(steps):
        n = lanes if t < lens[-1] else lanes - 1
        x, a, b, row, lo, r = grid[t, :n], a[:n], b[:n], row[:n], low[:n], rng[:n]
        if t and t % REFRESH == 0:
            m.refresh(seen)
        m.predict(row, _take(_HASH1, a) ^ _take(_HASH2, b))
        near = np.minimum(x, start.k)
        own = _take(start.cell, row + near)
        row = near * np.int64(wide)
        freq, cum = (own & 0xFFFF), own >> 16
        hit = m.guess == x
        hits, rest = np.flatnonzero(hit), np.flatnonzero((freq == 0) > hit)
        begin, unit = m.divided(*m.parts(r), hits, rest)
        cum -= m.out_freq * (cum > m.out_cum)
        y = _take(x, rest)
        c = _take(start.cls, y)
        at = _take(m.at_cum, rest) + c
        f, at = m.between(at)
        seen.append(_take(m.at_class, rest) + c)
        freq[hits], cum[hits] = 1, 0
        freq[rest], cum[rest] = f * _take(start.share, y), at * _ID_ALL + f * _take(start.begin, y)
        lo += begin
        lo += unit * cum.astype(_U)
        np.multiply(unit, freq.astype(_U), out=r)
        at, word = _settle(lo, r)
        to = _take(size, at)
        code[to] = word
        size[at] = to + 1
        m.update(x, hits, rest)
        a, b = x, a
    for shift in (32, 0):
        code[size] = (low >> _U(shift)) & _U(0xFFFFFFFF)
        size += 1
    out, n = [], 0
    flat = ids.astype("<u4").tobytes()
    for i, (end, k) in enumerate(zip(size.tolist(), lens.tolist(), strict=True)):
        out.append((code[i * room : end].astype("<u4").tobytes(), k, zlib.crc32(flat[4 * n : 4 * (n + k)])))
        n += k
    return out


def decode_blocks(start: StartModel, codes: list[bytes], lens: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """The ids of blocks, one after the other; a wrong checksum is an error."""
    start.decoding()
    out = []
    for i in range(0, len(codes), LANES):
        with np.errstate(divide="ignore"):  # damaged codes may leave no range; their checksums tell
            out.append(_decode_lanes(start, codes[i : i + LANES], np.asarray(lens[i : i + LANES], np.int64), np.asarray(crcs[i : i + LANES])))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _decode_lanes(start: StartModel, codes: list[bytes], lens: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    order, active = _layout(lens)
    lanes, steps = len(lens), len(active)
    room = max(len(c) for c in codes) // 4 + 2
    code = np.zeros(lanes * room, _U)
    for lane, where in enumerate(order.tolist()):
        w = np.frombuffer(codes[where], "<u4")
        code[lane * room : lane * room + len(w)] = w
    used = np.arange(lanes, dtype=np.int64) * room
    value = (code[used] << _U(32)) | code[used + 1]
    used += 2
    grid = np.zeros((steps, lanes), np.int32)
    seen: list[np.ndarray] = []
    m, wide = _Lanes(start, lanes, True), start.k + 1
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    a = b = near = row = np.zeros(lanes, np.int64)
    for t in range(steps):
        n = active[t]
        a, b, near, row, lo, r = a[:n], b[:n], near[:n], row[:n], low[:n], rng[:n]
        if t and t % REFRESH == 0:
            m.refresh(seen)
        m.predict(row, _take(_HASH1, a) ^ _take(_HASH2, b))
        v = value[:n] - lo
        unit, two, one = m.parts(r)
        hits, rest = np.flatnonzero(v < two), np.flatnonzero(v >= one)
        begin, unit = m.divided(unit, two, one, hits, rest)
        v -= begin
        s = (v // unit).view(np.int64)
        z = np.minimum(_take(s, rest), _CLASS_ALL * _ID_ALL - 1)
        np.minimum(s, _ROW_ALL - 1, out=s)
        s += m.out_freq * (s >= m.out_cum)
        s += _take(start.row_at, near)
        x = _take(start.in_row, s).astype(np.int32)
        c = _take(m.place, _take(m.at_place, rest) + z // _ID_ALL).astype(np.int64)
        f, at = m.between(_take(m.at_cum, rest) + c)
        seen.append(_take(m.at_class, rest) + c)
        y = _take(start.in_class, _take(start.has, c) * _ID_ALL + (z - at * _ID_ALL) // f)
        x[rest], x[hits] = y, _take(m.guess, hits)
        near = np.minimum(x, start.k)
        own = _take(start.cell, row + near)
        row = near * np.int64(wide)
        freq, cum = own & 0xFFFF, own >> 16
        cum -= m.out_freq * (cum > m.out_cum)
        freq[hits], cum[hits] = 1, 0
        freq[rest], cum[rest] = f * _take(start.share, y), at * _ID_ALL + f * _take(start.begin, y)
        lo += begin
        lo += unit * cum.astype(_U)
        np.multiply(unit, freq.astype(_U), out=r)
        at, _ = _settle(lo, r)
        of = _take(used, at)
        value[at] = (_take(value, at) << _U(32)) | _take(code, of)
        used[at] = of + 1
        grid[t, :n] = x
        m.update(x, hits, rest)
        a, b = x, a
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    grid = np.ascontiguousarray(grid.T)
    ids = start.alphabet.astype("<u4")[np.concatenate([grid[lane, :k] for lane, k in zip(back.tolist(), lens.tolist(), strict=True)])]
    n, flat = 0, ids.tobytes()
    for i, k in enumerate(lens.tolist()):
        if zlib.crc32(flat[4 * n : 4 * (n + k)]) != crcs[i]:
            raise ValueError(f"checksum of block {i} is wrong")
        n += k
    return ids


# -- shards -----------------------------------------------------------------


def write_shard(sink, docs: list[tuple[int | None, int]], ids: np.ndarray) -> None:
    """Writes one shard; ``docs`` are (id, number of ids) in file order."""
    start, blocks = encode_blocks(ids)
    model = start.to_bytes()
    sink.write(MAGIC + model)
    at = len(MAGIC) + len(model)
    entries = np.zeros(len(blocks), _ENTRY)
    for i, (code, n, crc) in enumerate(blocks):
        entries[i] = (at, len(code), n, crc)
        sink.write(code)
        at += len(code)
    index = np.zeros(len(docs), _DOC)
    index["doc_id"] = [0 if d is None else d for d, _ in docs]
    index["null"] = [d is None for d, _ in docs]
    index["n"] = [n for _, n in docs]
    tables = index.tobytes() + entries.tobytes()
    sink.write(tables)
    sink.write(_TRAILER.pack(len(model), at, len(index), at + index.nbytes, len(entries), len(ids), zlib.crc32(tables, zlib.crc32(model))))


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document index and all ids of a shard, checksums verified."""
    if len(data) < len(MAGIC) + _TRAILER.size or data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    model, at, n, blocks_at, blocks, _, crc = _TRAILER.unpack_from(data, len(data) - _TRAILER.size)
    model = data[len(MAGIC) : len(MAGIC) + model]
    if zlib.crc32(data[at : blocks_at + blocks * _ENTRY.itemsize], zlib.crc32(model)) != crc:
        raise ValueError("not a whole token shard")
    index = np.frombuffer(data, _DOC, n, at)
    entries = np.frombuffer(data, _ENTRY, blocks, blocks_at)
    codes = [data[e["at"] : e["at"] + e["bytes"]] for e in entries]
    return index, decode_blocks(StartModel.from_bytes(model), codes, entries["ids"], entries["crc"])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class _Numbers:
    """Numbers of 64-bit keys: open addressing in arrays, for many keys at once."""

    def __init__(self, most: int) -> None:
        self.size = 1 << (2 * most - 1).bit_length()
        self.keys, self.numbers = np.zeros(self.size, _U), np.full(self.size, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        slot = (keys & _U(self.size - 1)).view(np.int64)
        out = _take(self.numbers, slot)
        open_ = np.flatnonzero((_take(self.keys, slot) != keys) & (out >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.size - 1)
            at = slot[open_]
            out[open_] = self.numbers.take(at)
            open_ = open_[(self.keys.take(at) != keys[open_]) & (out[open_] >= 0)]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """New keys, all different."""
        slot = (keys & _U(self.size - 1)).view(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.numbers.take(slot[left]) < 0]
            self.keys[slot[free]] = keys[free]
            mine = free[self.keys.take(slot[free]) == keys[free]]
            self.numbers[slot[mine]] = numbers[mine]
            left = np.setdiff1d(left, mine, assume_unique=True)
            slot[left] = (slot[left] + 1) & (self.size - 1)


class _Library:
    """The tokenizers library behind a cache of white-space separated pieces.

    White space separates pre-tokens of this kind of vocabulary and is dropped,
    so a text's ids are those of its pieces.  A piece is known by a 64-bit hash,
    its length and its first eight bytes.  ASCII marks at the end of a new piece
    after a Latin-1 letter or an ASCII digit are cut off, and pieces of Latin-1
    letters are lowered; words that are new then go to the library's model, what
    else is new to the library, all as one text.  The ids that end a pre-token,
    and the number of pre-tokens of each piece, tell where a piece ends.  Pieces
    with a special token or odd white space, and vocabularies of another kind,
    are encoded by the library as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [s["type"] for s in steps]
        dropped = kinds == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        suffix = spec["model"].get("end_of_word_suffix")
        lowers = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", []))
        self.by_piece = bool(dropped and lowers and suffix and not any(" " in s or s[-1] in ".,;:!?" or s.isalnum() for s in self.special))
        if self.by_piece:
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            self.characters = {b: c for b, c in enumerate(byte_characters()) if chr(b) != c}
            self.code_points = np.array([ord(c) for c in byte_characters()], "<u4")
            self.marks = np.array([b < 0x80 and not chr(b).isalnum() and chr(b).isprintable() and b != 0x20 for b in range(256)])
            self.marks[[s.encode()[-1] for s in self.special]] = False  # so none reaches into the marks that are cut off
            self.forget()

    def forget(self) -> None:
        self.numbers, self.ids, self.checks = _Numbers(CACHE_WORDS), _Ragged(), np.zeros(1 << 16, _U)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces and how many each has; None where the pieces can't be told apart."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = " ".join(texts)
        parts = self.tokenizer.normalizer.normalize_str(text).split(" ")
        ids = np.array(self._whole([text])[0], np.int64)
        find = self.pattern.findall
        words = np.array([1 if p.isalpha() else len(find(p)) for p in parts], np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(parts) != len(texts) or len(ends) != words.sum():
            return None
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])])

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has; lower-case words in normal form are pre-tokens as they are."""
        tokenize, characters = self.tokenizer.model.tokenize, self.characters
        ids: list[int] = []
        many, other = np.zeros(len(pieces), np.int64), []
        for i, w in enumerate(pieces):
            if w.isalpha():
                found = tokenize(w.decode())
            elif not w.isascii() and (t := w.decode()).isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t):
                found = tokenize(w.decode("latin-1").translate(characters))
            else:
                other.append(i)
                continue
            ids += [t.id for t in found]
            many[i] = len(found)
        if not other:
            return np.array(ids, np.int64), many
        flat, many[other] = self._other([pieces[i] for i in other])
        out, own = np.zeros(many.sum(), np.int64), np.zeros(len(pieces), bool)
        own[other] = True
        own = np.repeat(own, many)
        out[own], out[~own] = flat, ids
        return out, many

    def _other(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in pieces]
        all_ = " ".join(texts)
        odd = [False] * len(texts)
        if _BLANK.search(all_) or any(s in all_ for s in self.special):
            odd = [_BLANK.search(t) is not None or any(s in t for s in self.special) for t in texts]
        plain = self._plain([t for t, o in zip(texts, odd, strict=True) if not o])
        if plain is None:
            odd, plain = [True] * len(texts), self._plain([])
        if not any(odd):
            return plain
        ids, lens = plain
        own, whole = iter(np.split(ids, np.cumsum(lens)[:-1]) if len(lens) else ()), iter(self._whole([t for t, o in zip(texts, odd, strict=True) if o]))
        rows = [next(whole) if o else next(own) for o in odd]
        return np.concatenate([np.asarray(r, np.int64) for r in rows]), np.array([len(r) for r in rows], np.int64)

    def _append(self, flat: np.ndarray, lens: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        """Rows of ids, and the pieces they are known by."""
        rows = self.ids.rows + np.arange(len(lens))
        self.ids.extend(flat, lens)
        while self.ids.rows > len(self.checks):
            self.checks = np.concatenate([self.checks, np.zeros_like(self.checks)])
        self.checks[rows] = checks
        self.numbers.add(keys, rows)

    def _words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case Latin-1 letters and how many each has; such words are pre-tokens as they are."""
        tokenize, text = self.tokenizer.model.tokenize, self.code_points.take(data).tobytes().decode("utf-32-le")
        ids, many = [], []
        for i, j in zip(starts.tolist(), stops.tolist(), strict=True):
            found = [t.id for t in tokenize(text[i:j])]
            ids += found
            many.append(len(found))
        return np.array(ids, np.int64), np.array(many, np.int64)

    def _learn(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        """Adds new pieces, all different."""
        lens = stops - starts
        ends = np.cumsum(lens)
        begins = ends - lens
        data = data.take(np.repeat(starts - begins, lens) + np.arange(ends[-1]))
        letter, upper = _latin(data)
        # where the marks at the end begin
        stop = np.where(self.marks.take(data), -1, np.arange(len(data)))
        np.maximum.accumulate(stop, out=stop)
        stop = np.maximum(stop.take(ends - 1) + 1, begins)
        marked = (stop < ends) & (stop > begins)
        marked &= (letter | _DIGIT.take(data)).take(stop - 1)
        stop = np.where(marked, stop, ends)
        others, uppers = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (~letter, upper))
        word = others.take(stop) == others.take(begins)
        lowered = word & (uppers.take(stop) > uppers.take(begins))
        data[np.repeat(lowered, lens) & upper] += 0x20
        derived = marked | lowered
        at = np.flatnonzero(word & ~derived)
        if len(at):
            self._append(*self._words(data, begins[at], ends[at]), keys[at], checks[at])
        at = np.flatnonzero(~word & ~derived)
        if len(at):
            flat = data.tobytes()
            self._append(*self._encoded([flat[i:j] for i, j in zip(begins[at].tolist(), ends[at].tolist(), strict=True)]), keys[at], checks[at])
        at = np.flatnonzero(derived)
        if len(at):
            marked, stop = marked[at], stop[at]
            to = np.arange(len(at)) + np.cumsum(marked) - marked
            rows = np.zeros(len(at) + marked.sum(), np.int64)
            rows[to] = self._rows(data, begins[at], stop)
            rows[to[marked] + 1] = self._rows(data, stop[marked], ends[at][marked])
            ids, lens = self.ids.take(rows)
            many = lens[to]
            many[marked] += lens[to[marked] + 1]
            self._append(ids, many, keys[at], checks[at])

    def _rows(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The row of each piece in ``ids``; new pieces are learned."""
        keys, checks = _piece_keys(data, starts, stops)
        rows = self.numbers.find(keys).astype(np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            at = new[first]
            self._learn(data, starts[at], stops[at], keys[at], checks[at])
            rows[new] = self.numbers.find(keys[new])
        for i in np.flatnonzero(_take(self.checks, rows) != checks).tolist():  # another piece has the same hash
            ids, lens = self._encoded([data[starts[i] : stops[i]].tobytes()])
            rows[i] = self.ids.rows
            self.ids.extend(ids, lens)
            if self.ids.rows > len(self.checks):
                self.checks = np.concatenate([self.checks, np.zeros_like(self.checks)])
        return rows

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has (null: empty)."""
        if not self.by_piece:
            rows = self._whole([t or "" for t in column.to_pylist()])
            return np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows], np.int64)
        data, offsets = text_bytes(column)
        out, count = [], []
        for i, j in chunks(offsets, PIECE_BYTES):
            if self.ids.rows > CACHE_WORDS:
                self.forget()
            part = data[offsets[i] : offsets[j]]
            starts, stops, bounds = word_spans(part, offsets[i : j + 1] - offsets[i], SPACE)
            flat, lens = self.ids.take(self._rows(part, starts, stops))
            out.append(flat)
            count.append(np.diff(np.concatenate([[0], np.cumsum(lens)])[bounds]))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate(count) if count else np.zeros(0, np.int64)


_BLANK = re.compile(r"[^\S ]")  # white space, as the vocabulary's pattern has it, that does not separate pieces
_DIGIT = np.array([chr(b).isdigit() and b < 0x80 for b in range(256)])
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
_ASCII_UPPER = np.array([chr(b).isupper() and b < 0x80 for b in range(256)])
# the second byte of U+00C0 to U+00FF: letters that are whole in normal form, but for two signs
_LATIN_SECOND = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_LATIN_UPPER = np.array([0x80 <= b <= 0x9E and b != 0x97 for b in range(256)])
#: Text bytes whose pieces are looked up at once.
PIECE_BYTES = 1 << 20
_STEP = _U(int(seeds(1, 21)[0]) | 1)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_UPTO = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], _U)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a step, and of its inverse modulo 2^64."""
    up, down = np.full(n, _STEP, _U), np.full(n, _BACK, _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def _latin(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the letters of ASCII and U+00C0 to U+00FF, and those that 0x20 lowers."""
    letter, upper = _ASCII_LETTER.take(data), _ASCII_UPPER.take(data)
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[_LATIN_SECOND.take(data[at + 1])]
    letter[at] = letter[at + 1] = True
    upper[at + 1] = _LATIN_UPPER.take(data[at + 1])
    return letter, upper


def _piece_keys(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each piece, from differences of one running sum, and its length and first eight bytes."""
    n = len(data)
    up, down = _powers(max(PIECE_BYTES, 1 << (n - 1).bit_length() if n else 1))
    sums = np.zeros(n + 1, _U)
    np.multiply(data, up[:n], out=sums[1:], dtype=_U)
    np.cumsum(sums, out=sums)
    lens = stops - starts
    keys = mix64((_take(sums, stops) - _take(sums, starts)) * _take(down, starts) + lens.astype(_U) * _BACK)
    words = np.ndarray(n, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
    head = words[starts] & _take(_UPTO, np.minimum(lens, 8))
    return keys, head ^ (lens.astype(_U) * _STEP)


@lru_cache(maxsize=2)
def _library(path: str) -> _Library:
    return _Library(path)


#: Texts that are encoded at once.
TEXTS = 2000


def _write(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = _library(path)
        docs: list[tuple[int | None, int]] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                flat, lens = lib.encode(part.column("_text"))
                ids.append(np.insert(flat, np.cumsum(lens), end).astype(np.uint32))
                docs += zip(part.column("doc_id").to_pylist(), (lens + 1).tolist(), strict=True)
        if not docs:
            return
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"tokens-{uuid.uuid4().hex}.gwt"  # of this attempt only; a lost attempt's file is in no manifest
        with fs.open_output_stream(f"{root}/{name}") as sink:
            write_shard(sink, docs, np.concatenate(ids))
        # tasks are ranges of ids, in order
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name])], ["shard", "name"])
        del docs, ids
        tidy()

    return run


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards of ascending ids to ``folder``; returns their manifest: shard, name.

    Shards are ranges of ids, so that order is global; rows of one id are dealt
    out as well.
    """
    spark = arrow_session(docs.sparkSession)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * input_bytes(docs) // SHARD_BYTES)
    src = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("_text")).withColumn("_nth", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_nth")]
    ordered = src.repartitionByRange(int(shards), *order).sortWithinPartitions(*order).select("doc_id", "_text")
    return cut(ordered.mapInArrow(_write(folder, path, end), "shard long, name string"))


def shard_ids(fs: pafs.FileSystem, path: str) -> int:
    """The number of ids of a shard, from its trailer."""
    with fs.open_input_file(path) as f:
        f.seek(f.size() - _TRAILER.size)
        return _TRAILER.unpack(f.read(_TRAILER.size))[5]


def _sizes(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            ids = [shard_ids(fs, f"{root}/{name}") for name in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], ["shard", "name", "ids"])

    return run


#: Shards whose numbers of ids are added up together.
TOGETHER = 4096


def shard_starts(manifest: DataFrame, folder: str) -> DataFrame:
    """(name, before): the ids in all shards before each, from the shards' own trailers."""
    sizes = cut(manifest.select("shard", "name").mapInArrow(_sizes(folder), "shard long, name string, ids long")).withColumn("some", F.floor(F.col("shard") / TOGETHER))
    # one row for each TOGETHER shards
    far = sizes.groupBy("some").agg(F.sum("ids").alias("all")).select("some", F.coalesce(F.sum("all").over(W.orderBy("some").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum("ids").over(W.partitionBy("some").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("near", near).join(far, "some").select("name", (F.col("far") + F.col("near")).alias("before"))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    index, ids = read_shard(f.read())
                flat = memoryview(ids.tobytes())
                ends = np.cumsum(index["n"].astype(np.int64))
                crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), index["n"].tolist(), strict=True)]
                doc = pa.array(index["doc_id"], mask=index["null"] > 0)
                yield pa.RecordBatch.from_arrays([doc, pa.array(before + ends - index["n"]), pa.array(index["n"].astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        tidy()

    return run


def read_report(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    rows = cut(shard_starts(manifest, folder))
    rows = rows.repartition(max(1, min(rows.count(), 10_000)))
    return rows.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(folder: str, name: str, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a shard; reads only the start model and the blocks that hold them."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        f.seek(f.size() - _TRAILER.size)
        model, _, _, blocks_at, blocks, _, _ = _TRAILER.unpack(f.read(_TRAILER.size))
        f.seek(len(MAGIC))
        start = StartModel.from_bytes(f.read(model))
        f.seek(blocks_at)
        entries = np.frombuffer(f.read(blocks * _ENTRY.itemsize), _ENTRY)
        i, j = first // BLOCK, -(-(first + n) // BLOCK)
        some = entries[i:j]
        codes = []
        for e in some:
            f.seek(int(e["at"]))
            codes.append(f.read(int(e["bytes"])))
    return decode_blocks(start, codes, some["ids"], some["crc"])[first - i * BLOCK :][:n]


def store_report(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Writes the token files of a corpus to the shared folder and reports what they hold."""
    folder = shared_dir(docs.sparkSession)
    return read_report(write_tokens(docs, path, folder, end), folder)
