"""Language ID of mixed-language text: scripts, word scores, Viterbi spans.

A model holds, for each language, log-probabilities of hashed letter n-grams
and the scripts that its training text uses.  The script of a word narrows its
candidate languages; the remaining ones are scored by the word's n-grams.  A
Viterbi pass with a constant penalty for changing the language between two
words labels every word, so a text becomes spans of one language each.  The
language of a text is the one with most letters in its spans, and its score is
their share of all letters.

The texts of a batch are worked on together: step ``t`` of the Viterbi pass
handles word ``t`` of all texts that still have one.

A word is a letter and the letters and marks that follow it.  Words of a script
that no language has count among a text's letters, but for no language.

Defined results: a null text or one without a letter is ``und`` with score 0; a
text whose scripts no language has gets the language that sorts first, with
score 0; ties go to the language that sorts first; without any labelled text
everything is ``und``; repeated rows are each labelled, and learned from, alike;
an empty table gives no rows; a very long text is labelled whole, in a batch of
its own.  Labels are only read in ``fit``, and columns are told apart by place,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U, arrow_session, column, crc_mod, mix64, numbered, share_of, tidy

#: Labelled documents to learn from, about; the sample is by a hash of the id.
TRAIN_ROWS = 8_000
#: Buckets of hashed n-grams.
FEATURES = 1 << 15
#: Log-probability that a change of language costs.
SWITCH = 12.0
#: A word of a script that a language has in less than this share is not its own.
SCRIPT_SHARE = 0.01
#: Added to all counts.
SMOOTH = 0.5
#: Words that a worker keeps the scores of.
CACHE_WORDS = 200_000
#: Texts with a lower score have no clear language.
CLEAR = 0.35
UND = "und"

# First code points of Unicode script ranges, and their scripts.
_SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "other"),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_FIRST = np.array([a for a, _ in _SCRIPTS])
SCRIPT_NAMES = sorted({b for _, b in _SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(b) for _, b in _SCRIPTS])
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def script_of(word: str) -> int:
    """Number of the script of a word's first letter."""
    return int(_SCRIPT_OF[np.searchsorted(_FIRST, ord(word[0]), side="right") - 1])


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of each lower-cased word, marked at its ends, and their owners."""
    marked = [f"^{w}$" for w in words]
    lens = np.array([len(w) for w in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(U)
    owner = np.repeat(np.arange(len(words)), lens)
    out, own = [], []
    for n in (1, 2, 3):
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n, U)
        for i in range(n):
            h = mix64(h * U(0x9E3779B97F4A7C15) + code[i : len(code) - n + 1 + i])
        ok = owner[: len(h)] == owner[n - 1 :]
        out.append((h[ok] % U(FEATURES)).astype(np.int64))
        own.append(owner[: len(h)][ok])
    return (np.concatenate(out), np.concatenate(own)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    """Languages, n-gram log-probabilities (features x languages), allowed scripts."""

    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each language, best 0; barred scripts far below."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        bucket, owner = ngram_buckets(words)
        out = np.stack([np.bincount(owner, self.logp[bucket, i], minlength=len(words)) for i in range(len(self.langs))], 1)
        ok = self.allowed[np.array([script_of(w) for w in words])]
        out[~ok.any(1)] = 0
        out = np.where(ok | ~ok.any(1)[:, None], out, -1e4)
        return (out - out.max(1, keepdims=True)).astype(np.float32)

    def counted_letters(self, words: list[str]) -> np.ndarray:
        """Letters that a word counts for its language: none where no language has its script."""
        ok = self.allowed.any(1)
        return np.array([len(w) if ok[script_of(w)] else 0 for w in words], np.int32)


def _counted(langs: list[str]):
    at = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), FEATURES), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist(), strict=True):
                words = _WORD.findall((text or "").lower())
                if not words:
                    continue
                i = at[lang]
                bucket, _ = ngram_buckets(words)
                grams[i] += np.bincount(bucket, minlength=FEATURES)
                first = np.frombuffer("".join([w[0] for w in words]).encode("utf-32-le"), np.uint32)
                scripts[i] += np.bincount(_SCRIPT_OF[np.searchsorted(_FIRST, first, side="right") - 1], minlength=len(SCRIPT_NAMES))
        both = np.concatenate([grams, scripts], 1)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j])], ["lang", "feature", "n"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learns from about ``rows`` documents whose crc32(id) mod 3 is not 1 and whose label is not null.

    What comes to the driver is one number for each language and feature.
    """
    arrow_session(docs.sparkSession)
    pool = docs.filter((crc_mod(column(id_col)) != 1) & column(lang_col).isNotNull())
    seen = {r[0]: r[1] for r in pool.groupBy(column(lang_col).cast("string")).count().collect()}
    langs = sorted(seen)
    share = min(1.0, rows / max(1, sum(seen.values())))
    some = pool.filter(share_of(F.xxhash64(F.lit(6), column(id_col), column(text_col)), share))
    some = some.select(column(text_col).alias("_text"), column(lang_col).cast("string").alias("_lang"))
    n = np.zeros((len(langs), FEATURES + len(SCRIPT_NAMES)))
    if langs:
        for r in some.mapInArrow(_counted(langs), "lang long, feature long, n long").groupBy("lang", "feature").agg(F.sum("n")).toLocalIterator():
            n[r[0], r[1]] = r[2]
    keep = [i for i in range(len(langs)) if n[i].sum() > 0]
    grams, scripts = n[keep, :FEATURES] + SMOOTH, n[keep, FEATURES:]
    logp = np.log(grams / grams.sum(1, keepdims=True)).T if keep else np.zeros((FEATURES, 0))
    allowed = (scripts >= SCRIPT_SHARE * scripts.sum(1, keepdims=True)).T if keep else np.zeros((len(SCRIPT_NAMES), 0), bool)
    return Model([langs[i] for i in keep], logp.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word; ``scores`` has the words of text d in rows bounds[d]:bounds[d+1]."""
    n, states = scores.shape
    lens = np.diff(bounds)
    order = np.argsort(-lens, kind="stable")
    lens, starts = lens[order], bounds[:-1][order]
    path = np.zeros(n, np.int32)
    if not n:
        return path
    steps = int(lens[0])
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # texts with more than t words
    stay = np.zeros((n, states), bool)
    jump = np.zeros(n, np.int32)
    v = scores[starts[: active[0]]].copy()
    ends = np.zeros(len(lens), np.int32)
    ends[: active[0]] = v.argmax(1)
    for t in range(1, steps):
        a = active[t]
        rows = starts[:a] + t
        v = v[:a]
        best = v.argmax(1)
        top = v[np.arange(a), best] - switch
        jump[rows] = best
        keep = v >= top[:, None]
        stay[rows] = keep
        v = np.where(keep, v, top[:, None]) + scores[rows]
        v -= v.max(1, keepdims=True)
        ends[:a] = v.argmax(1)
    state = ends
    for t in range(steps - 1, -1, -1):
        a = active[t]
        rows = starts[:a] + t
        path[rows] = state[:a]
        if t:
            state[:a] = np.where(stay[rows, state[:a]], state[:a], jump[rows])
    return path


class _Words(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class Labeller:
    """Labels texts with a model; keeps the scores of the words it has seen."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        room = 1 << 12
        self.words, self.table = _Words(), np.zeros((room, len(self.model.langs)), np.float32)
        self.letters, self.counted = np.zeros(room, np.int32), np.zeros(room, np.int32)

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        first, last = len(self.words) - len(new), len(self.words)
        while last > len(self.letters):
            self.table, self.letters, self.counted = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.letters, self.counted))
        self.table[first:last] = self.model.word_scores(new)
        self.letters[first:last] = [len(w) for w in new]
        self.counted[first:last] = self.model.counted_letters(new)

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language of each word, its letters, those that count for a language, and the bounds of the texts."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        rows = []
        for text in texts:
            found = _WORD.findall(text.lower()) if text else ()
            rows.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        if self.words.new:
            self._learn()
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return viterbi(self.table[at], bounds), self.letters[at], self.counted[at], bounds


#: Texts that are labelled at once.
TEXTS = 512


def _labelled(model: Model, keep: list[str], spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(model)
        k = len(model.langs)
        for whole in batches:
            for first in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(first, TEXTS)
                n = batch.num_rows
                langs, score, parts = np.full(n, UND, object), np.zeros(n), [[] for _ in range(n)]
                if k:
                    path, letters, counted, bounds = own.label(batch.column("_text").to_pylist())
                    doc = np.repeat(np.arange(n), np.diff(bounds))
                    mass = np.bincount(doc * k + path, counted, minlength=n * k).reshape(n, k)
                    total = np.bincount(doc, letters, minlength=n)
                    has = total > 0
                    best = mass.argmax(1)
                    langs[has] = np.array(model.langs, object)[best[has]]
                    score[has] = (mass[np.arange(n), best] / np.maximum(total, 1))[has]
                    if spans:
                        new = np.ones(len(path), bool)
                        new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
                        at = np.flatnonzero(new)
                        last = np.concatenate([at[1:], [len(path)]])
                        for a, b in zip(at.tolist(), last.tolist(), strict=True) if len(at) else ():
                            d = int(doc[a])
                            parts[d].append({"lang": model.langs[path[a]], "word": int(a - bounds[d]), "words": b - a})
                cols = [batch.column(c) for c in keep] + [pa.array(langs.tolist(), pa.string()), pa.array(score)]
                names = [*keep, "lang_pred", "score"]
                if spans:
                    cols.append(pa.array(parts, pa.list_(pa.struct([("lang", pa.string()), ("word", pa.int32()), ("words", pa.int32())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names)
        del own
        tidy()

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and, as asked, the spans (language, first word, words)."""
    arrow_session(docs.sparkSession)
    at = [docs.columns.index(n) for n in keep] if keep is not None else range(len(docs.columns))
    own = [f"_c{i}" for i in at]
    src = numbered(docs).select(*own, F.col(f"_c{docs.columns.index(text_col)}").alias("_text"))
    schema = ", ".join(f"_c{i} {docs.schema[i].dataType.simpleString()}" for i in at)
    out = src.mapInArrow(_labelled(model, own, spans), f"{schema}{', ' if own else ''}lang_pred string, score double" + ", spans array<struct<lang:string,word:int,words:int>>" * spans)
    return out.toDF(*[docs.columns[i] for i in at], *out.columns[len(own) :])


def keep_clear(docs: DataFrame, model: Model, text_col: str = "text", clear: float = CLEAR) -> DataFrame:
    """The documents whose language is known with at least the score ``clear``; columns as they are."""
    labelled = predict(docs, model, text_col)
    n = len(docs.columns)
    labelled = labelled.toDF(*[f"_c{i}" for i in range(n)], "_lang", "_score")
    return labelled.filter((F.col("_lang") != UND) & (F.col("_score") >= clear)).drop("_lang", "_score").toDF(*docs.columns)
