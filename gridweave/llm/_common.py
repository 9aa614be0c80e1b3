"""What the text operators share: sessions, vectorised words, hashes.

Texts reach Python as Arrow batches.  They are split and hashed as byte arrays
with numpy, in chunks of bounded size, so that no Python object is made for
each word and a worker's memory does not follow the size of a partition.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are held as 64-bit arrays at once.  A longer text is held alone, at about 35 bytes for each of its own.
CHUNK_BYTES = 2 << 20
#: Rows, and bytes, of one Arrow batch handed to Python; a longer row is a batch of its own.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20

U = np.uint64


def arrow_session(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that go to Python workers.

    Plans read these settings when they run, so they stay in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def column(name: str) -> Column:
    """The column of just this name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame) -> DataFrame:
    """The frame with its columns named by place: ``_c0``, ``_c1``, ...; no name can clash or be misread."""
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])


def tidy() -> None:
    """Hands freed memory of a Python worker back; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where it is
    unset, as in tests, a folder below the warehouse is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gridweave-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: rows are written to the shared folder and reread."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Deletes what ``cut`` wrote, once nothing that is still to run reads it."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's size, without running anything; 0 where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def crc_mod(col: str | Column, mod: int = 3) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (null id: of '')."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def share_of(key: Column, share: float) -> Column:
    """Whether a 64-bit hash falls into a share of all hashes, however small."""
    return F.shiftrightunsigned(key, 2) < F.lit(min(1 << 62, round(share * (1 << 62))))


# -- hashes -----------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int = 1) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix64((np.arange(1, n + 1, dtype=U) + U(salt << 20)) * U(0x9E3779B97F4A7C15)) | U(1)


_BYTE = seeds(256, 7)
_Q = int(seeds(1, 9)[0])
_POW = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        base = np.full(max(n, 64), U(_Q))
        base[0] = U(1)
        _POW = np.cumprod(base, dtype=U)
    return _POW


# -- words ------------------------------------------------------------------

#: Bytes that end a word when words are what lies between ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word when words are runs of letters, digits and non-ASCII.
NON_WORD = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])


def text_bytes(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if lower:
        import pyarrow.compute as pc

        column = pc.utf8_lower(column)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes, a longer document alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each document."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~sep[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends = inside[:-1] & ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes."""
    if not len(starts):
        return np.zeros(0, U)
    n = len(data)
    lens = stops - starts
    pos = np.arange(n, dtype=np.int64)
    first = np.zeros(n, np.int64)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    pos -= first
    pw = _powers(int(lens.max()) + 1)
    np.minimum(pos, len(pw) - 1, out=pos)
    vals = _BYTE[data] * pw[pos]
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, stops
    if bounds[-1] == n:
        out = np.add.reduceat(vals, bounds[:-1])[0::2]
    else:
        out = np.add.reduceat(vals, bounds)[0::2]
    return mix64(out + lens.astype(U))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive hashes, by doubling."""
    if len(h) < k:
        return np.zeros(0, U)
    a = U(0x9E3779B97F4A7C15)
    out, have, level, size = None, 0, h, 1
    rest = k
    while rest:
        if rest & 1:
            part = level[have : have + len(h) - k + 1]
            out = part.copy() if out is None else mix64(out * a + part)
            have += size
        rest >>= 1
        if rest:
            level = mix64(level[:-size] * a + level[size:] + U(size))
            size *= 2
    return out


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each document and their bounds.

    A document of 1 to k-1 words has one shingle, of all its words.
    """
    n = np.diff(bounds)
    have = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(have)])
    out = np.zeros(out_bounds[-1], U)
    roll = rolling(h, k)
    long = n >= k
    if long.any():
        keep = np.zeros(len(h) + 1, np.int64)
        np.add.at(keep, bounds[:-1][long], 1)
        np.add.at(keep, bounds[1:][long] - k + 1, -1)
        at = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        dest = np.repeat(out_bounds[:-1][long] - np.concatenate([[0], np.cumsum(have[long])])[:-1], have[long]) + np.arange(len(at))
        out[dest] = roll[at]
    for i in np.flatnonzero((n > 0) & (n < k)):
        x = np.array([n[i]], U)
        for j in range(bounds[i], bounds[i + 1]):
            x = mix64(x * U(0x9E3779B97F4A7C15) + h[j : j + 1])
        out[out_bounds[i]] = x[0]
    return out, out_bounds
