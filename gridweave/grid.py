"""The grid: voxels as rows, with the shape and the element type beside them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
KEYS = ["z", "y", "x"]

# The smallest and largest value of each integer element type.
RANGES = {
    "INT8": (-128, 127), "UINT8": (0, 255), "INT16": (-32768, 32767), "UINT16": (0, 65535),
    "INT32": (-2147483648, 2147483647), "UINT32": (0, 4294967295),
}
LABEL, BINARY, INDEX, FLOAT = "UINT32", "UINT8", "UINT32", "FLOAT"


@dataclass(frozen=True)
class Grid:
    """A dense n-dimensional array: rows (z, y, x, v), x fastest.

    ``shape`` is (width, height, depth).  It is metadata and never taken from
    the rows.  Every voxel has one row; ``v`` is a double in all element types.
    """

    df: DataFrame
    shape: tuple[int, int, int]
    dtype: str = FLOAT

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def ndim(self) -> int:
        w, h, d = self.shape
        return 3 if d > 1 else 2 if h > 1 else 1

    @property
    def size(self) -> int:
        w, h, d = self.shape
        return w * h * d

    def map(self, v: Column, dtype: str | None = None) -> Grid:
        """The same voxels with other values, as the element type stores them."""
        dtype = dtype or self.dtype
        return replace(self, df=self.df.select(*KEYS, store(v, dtype).alias("v")), dtype=dtype)

    def linear(self) -> Column:
        """Index of a voxel in x-fastest order."""
        w, h, _ = self.shape
        return F.col("x") + F.lit(w).cast("long") * (F.col("y") + F.lit(h).cast("long") * F.col("z"))

    def clamp(self, axis: str, at: Column) -> Column:
        """The nearest coordinate inside the grid."""
        return F.least(F.greatest(at, F.lit(0)), F.lit(self.shape[AXES.index(axis)] - 1))


def store(v: Column, dtype: str) -> Column:
    """What a write keeps of a computed value: saturated and truncated for integers (NaN: 0)."""
    if dtype == FLOAT:
        return v.cast("double")
    lo, hi = RANGES[dtype]
    v = v.cast("double")
    v = F.when(F.isnan(v), 0.0).otherwise(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)))
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")


def shape3(shape: tuple[int, ...]) -> tuple[int, int, int]:
    """Three extents, each at least 1."""
    w, h, d = (*shape, 1, 1)[:3]
    return max(1, int(w)), max(1, int(h)), max(1, int(d))


def positions(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """All coordinates of a shape, made in parallel."""
    w, h, d = shape
    i = F.col("id")
    return spark.range(w * h * d).select(
        F.floor(i / F.lit(w * h)).cast("int").alias("z"), (F.floor(i / F.lit(w)) % h).cast("int").alias("y"), (i % w).cast("int").alias("x"),
    )


def full(spark: SparkSession, shape: tuple[int, ...], value: float = 0.0, dtype: str = FLOAT) -> Grid:
    """A grid of one value."""
    shape = shape3(shape)
    return Grid(positions(spark, shape).withColumn("v", store(F.lit(float(value)), dtype)), shape, dtype)


def densify(sparse: DataFrame, shape: tuple[int, ...], fill: float = 0.0, dtype: str = FLOAT) -> Grid:
    """A grid from rows (z, y, x, v) for some voxels; the others get ``fill``."""
    shape = shape3(shape)
    rows = positions(sparse.sparkSession, shape).join(sparse.select(*(F.col(k).cast("int").alias(k) for k in KEYS), F.col("v").cast("double").alias("v")), KEYS, "left")
    return Grid(rows.select(*KEYS, F.coalesce("v", F.lit(float(fill))).alias("v")), shape, dtype)
