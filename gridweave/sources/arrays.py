"""Driver arrays, Arrow tables and relations as grids, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.grid import FLOAT, KEYS, Grid, densify, shape3


def from_numpy(spark: SparkSession, array: np.ndarray, dtype: str = FLOAT) -> Grid:
    """A small array of the driver ([x], [y, x] or [z, y, x]) as a grid."""
    a = np.asarray(array, float)
    a = a.reshape((1,) * (3 - a.ndim) + a.shape)
    z, y, x = (i.ravel().astype(np.int32) for i in np.indices(a.shape))
    return from_arrow(spark, pa.table({"z": z, "y": y, "x": x, "v": a.ravel()}), a.shape[::-1], dtype)


def from_arrow(spark: SparkSession, table: pa.Table, shape: tuple[int, ...], dtype: str = FLOAT) -> Grid:
    """Rows (z, y, x, v) of an Arrow table, one for each voxel."""
    return Grid(spark.createDataFrame(table).select(*KEYS, F.col("v").cast("double").alias("v")), shape3(shape), dtype)


def from_table(rows: DataFrame, shape: tuple[int, ...], dtype: str = FLOAT) -> Grid:
    """Rows (z, y, x, v) for some voxels; the others are 0."""
    return densify(rows, shape, 0.0, dtype)


def to_arrow(grid: Grid) -> pa.Table:
    """All voxels in x-fastest order."""
    return grid.df.orderBy(*KEYS).toArrow()


def to_numpy(grid: Grid) -> np.ndarray:
    """The array [z, y, x]; for grids that fit the driver."""
    w, h, d = grid.shape
    out = np.zeros((d, h, w))
    t = grid.df.toArrow()
    out[t["z"].to_numpy(), t["y"].to_numpy(), t["x"].to_numpy()] = t["v"].to_numpy()
    return out


def write_region(grid: Grid, part: Grid, at: tuple[int, int, int] = (0, 0, 0)) -> Grid:
    """The grid with ``part`` written at (x, y, z)."""
    moved = part.df.select((F.col("z") + at[2]).alias("z"), (F.col("y") + at[1]).alias("y"), (F.col("x") + at[0]).alias("x"), F.col("v").alias("new"))
    joined = grid.df.join(moved, KEYS, "left")
    return Grid(joined.select(*KEYS, "v", "new"), grid.shape, grid.dtype).map(F.coalesce("new", "v"))
