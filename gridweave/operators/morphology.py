"""Binary and footprint morphology, and the steps of label growth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridweave.grid import BINARY, Grid
from gridweave.operators.support import V
from gridweave.operators.filters import _checked, cross, faces, line, long_axes, maximum_filter, minimum_filter
from gridweave.plans.tiles import over_offsets



def _footprint(array: np.ndarray) -> list[tuple[int, int, int]]:
    a = np.asarray(array)
    a = a.reshape((1,) * (3 - a.ndim) + a.shape)
    return [tuple(int(i) - n // 2 for i, n in zip(at, a.shape, strict=True)) for at in np.argwhere(a != 0)]


def dilation(src: Grid, footprint: np.ndarray) -> Grid:
    """Largest value under a footprint array [z, y, x]."""
    return over_offsets(src, _footprint(footprint), lambda s: s.max(0))


def erosion(src: Grid, footprint: np.ndarray) -> Grid:
    """Smallest value under a footprint array."""
    return over_offsets(src, _footprint(footprint), lambda s: s.min(0))


def opening(src: Grid, footprint: np.ndarray) -> Grid:
    return dilation(erosion(src, footprint), footprint)


def closing(src: Grid, footprint: np.ndarray) -> Grid:
    return erosion(dilation(src, footprint), footprint)


def _set(src: Grid) -> Grid:
    return src.map(F.when(V() != 0, 1.0).otherwise(0.0))


def binary_dilate(src: Grid, radius_x: float = 1, radius_y: float = 1, radius_z: float = 1, connectivity: str = "box") -> Grid:
    return maximum_filter(_set(src), radius_x, radius_y, radius_z, connectivity)


def binary_erode(src: Grid, radius_x: float = 1, radius_y: float = 1, radius_z: float = 1, connectivity: str = "box") -> Grid:
    return minimum_filter(_set(src), radius_x, radius_y, radius_z, connectivity)


def binary_opening(src: Grid, radius_x: float = 1, radius_y: float = 1, radius_z: float = 1, connectivity: str = "box") -> Grid:
    r = (radius_x, radius_y, radius_z, connectivity)
    return binary_dilate(binary_erode(src, *r), *r)


def binary_closing(src: Grid, radius_x: float = 1, radius_y: float = 1, radius_z: float = 1, connectivity: str = "box") -> Grid:
    r = (radius_x, radius_y, radius_z, connectivity)
    return binary_erode(binary_dilate(src, *r), *r)


def binary_edge_detection(src: Grid) -> Grid:
    """Foreground voxels with a background voxel in their box; outside the grid there is none."""
    inner = _box_extreme(_set(src), F.min)
    return inner.map(F.when((F.col("c") != 0) & (F.col("m") == 0), 1.0).otherwise(0.0), BINARY)


def _box_extreme(src: Grid, agg) -> Grid:
    """Voxels with ``c`` the value and ``m`` the extreme of their box (nulls do not count)."""
    df = src.df.withColumns({"c": V(), "m": V()})
    for axis, _, _ in long_axes(src, (1, 1, 1)):
        df = df.withColumn("m", agg("m").over(line(axis).rowsBetween(-1, 1)))
    return Grid(df, src.shape, src.dtype)


def _nonzero(src: Grid, largest: bool, connectivity: str) -> Grid:
    agg, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    sparse = Grid(src.df.withColumn("v", F.when(V() != 0, V())), src.shape, src.dtype)
    if _checked(connectivity) == "box":
        df = _box_extreme(sparse, agg).df
    else:  # a zero never wins; it is no null, which would stand for the world outside
        never = F.lit(float("-inf" if largest else "inf"))
        df = cross(Grid(src.df.withColumn("v", F.when(V() != 0, V()).otherwise(never)), src.shape, src.dtype))
        df = df.withColumns({"c": F.when(V() != never, V()), "m": pick(V(), V(), *faces(df))})
    return Grid(df, src.shape, src.dtype).map(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0.0))


def nonzero_maximum(src: Grid, connectivity: str = "box") -> Grid:
    """Largest non-zero value around each non-zero voxel; zeros stay."""
    return _nonzero(src, True, connectivity)


def nonzero_minimum(src: Grid, connectivity: str = "box") -> Grid:
    """Smallest non-zero value around each non-zero voxel; zeros stay."""
    return _nonzero(src, False, connectivity)


def onlyzero_overwrite_maximum(src: Grid, connectivity: str = "box") -> Grid:
    """Zero voxels take the largest value around them, the others stay."""
    if _checked(connectivity) == "box":
        df = _box_extreme(src, F.max).df
    else:
        df = cross(src)
        df = df.withColumns({"c": V(), "m": F.greatest(V(), V(), *faces(df))})
    return Grid(df, src.shape, src.dtype).map(F.when(F.col("c") == 0, F.col("m")).otherwise(F.col("c")))
