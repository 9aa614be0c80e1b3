"""Tables of a lake as grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.grid import FLOAT, Grid, densify, shape3


def from_array_column(rows: DataFrame, y: Column, values: str, shape: tuple[int, ...]) -> Grid:
    """One image row for each table row: x is the place in the array column."""
    out = rows.select(F.lit(0).alias("z"), y.cast("int").alias("y"), F.posexplode(values).alias("x", "v"))
    return Grid(out.select("z", "y", "x", F.col("v").cast("double").alias("v")), shape3(shape), FLOAT)


def from_counts(rows: DataFrame, x: Column, y: Column, z: Column, shape: tuple[int, ...], value: Column | None = None, dtype: str = FLOAT) -> Grid:
    """A histogram cube of a table: number of rows, or the sum of ``value``, for each (x, y, z)."""
    keyed = rows.select(z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), (F.lit(1.0) if value is None else value.cast("double")).alias("v"))
    return densify(keyed.groupBy("z", "y", "x").agg(F.sum("v").alias("v")), shape, 0.0, dtype)
