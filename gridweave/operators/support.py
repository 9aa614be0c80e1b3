"""Joins and totals that several operators use."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.grid import AXES, KEYS, Grid


def V() -> Column:
    """The value of a voxel.  Columns need a running session, so modules hold none."""
    return F.col("v")


def W() -> Column:
    """The value of the other grid."""
    return F.col("w")


def X() -> Column:
    return F.col("x")


def Y() -> Column:
    return F.col("y")


def Z() -> Column:
    return F.col("z")


def with_totals(src: Grid, *totals: Column) -> Grid:
    """The grid with whole-grid aggregates beside every voxel (one row, broadcast)."""
    return replace(src, df=src.df.join(F.broadcast(src.df.agg(*totals))))


def pair(a: Grid, b: Grid, name: str = "w") -> DataFrame:
    """Voxels of ``a`` with the value of ``b`` at the same place as ``name``.

    An axis of extent 1 of ``b`` is the same for every place of ``a``.
    """
    keys = [k for k in KEYS if b.shape[AXES.index(k)] > 1 or a.shape[AXES.index(k)] == 1]
    right = b.df.select(*keys, F.col("v").alias(name))
    return a.df.join(right, keys) if keys else a.df.join(F.broadcast(right))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop: rows go to the shared checkpoint folder and back.

    The folder is ``spark.checkpoint.dir``; only where it is unset, as in
    tests, one below the warehouse is taken.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/grid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
