"""One grid, one voxel at a time: projections that never shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.functions import numeric as N
from gridweave.grid import AXES, FLOAT, INDEX, Grid, full
from gridweave.operators.support import V, with_totals


UNARY: dict[str, tuple[Callable[[Column], Column], str | None]] = {
    "absolute": (F.abs, None), "sin": (F.sin, None), "cos": (F.cos, None), "tan": (F.tan, None), "asin": (F.asin, None), "acos": (F.acos, None),
    "atan": (F.atan, None), "sinh": (F.sinh, None), "cosh": (F.cosh, None), "tanh": (F.tanh, None), "cubic_root": (F.cbrt, None),
    "square_root": (F.sqrt, None), "exponential": (F.exp, None), "exponential2": (lambda v: F.pow(F.lit(2.0), v), None),
    "exponential10": (lambda v: F.pow(F.lit(10.0), v), None), "logarithm": (N.logarithm, None),
    "logarithm2": (lambda v: N.logarithm(v, F.log2), None), "logarithm10": (lambda v: N.logarithm(v, F.log10), None),
    "reciprocal": (lambda v: N.divide(F.lit(1.0), v), None), "ceil": (F.ceil, None), "floor": (F.floor, None), "round": (F.round, None),
    "truncate": (N.truncate, None), "sign": (F.signum, None), "binary_not": (lambda v: F.when(v != 0, 0.0).otherwise(1.0), None),
    "undefined_to_zero": (lambda v: F.when(F.isnan(v) | (F.abs(v) == N.INF), 0.0).otherwise(v), None),
    "invert": (lambda v: -v, None), "square": (lambda v: v * v, None), "degrees_to_radians": (F.radians, FLOAT), "radians_to_degrees": (F.degrees, FLOAT),
}


def _unary(name: str, f: Callable[[Column], Column], dtype: str | None) -> Callable[[Grid], Grid]:
    def op(src: Grid) -> Grid:
        return src.map(f(V()), dtype)

    op.__name__ = name
    op.__doc__ = f"{name.replace('_', ' ').capitalize()} of each value."
    return op


globals().update({name: _unary(name, *how) for name, how in UNARY.items()})


def copy(src: Grid, dtype: str | None = None) -> Grid:
    """The grid itself, or stored as another element type."""
    return src.map(V(), dtype)


def nan_to_num(src: Grid, nan: float = 0.0, posinf: float = math.inf, neginf: float = -math.inf) -> Grid:
    """Replaces NaN and the infinities, each by its own value."""
    return src.map(F.when(F.isnan(V()), nan).when(V() == N.INF, posinf).when(V() == -N.INF, neginf).otherwise(V()))


def _scalar(src: Grid, v: Column) -> Grid:
    """Results with a scalar are rounded to even before an integer write."""
    return src.map(v if src.dtype == FLOAT else F.rint(v))


def add_image_and_scalar(src: Grid, scalar: float = 1) -> Grid:
    return _scalar(src, V() + F.lit(float(scalar)))


def subtract_image_from_scalar(src: Grid, scalar: float = 0) -> Grid:
    return _scalar(src, F.lit(float(scalar)) - V())


def multiply_image_and_scalar(src: Grid, scalar: float = 0) -> Grid:
    return _scalar(src, V() * F.lit(float(scalar)))


def divide_scalar_by_image(src: Grid, scalar: float = 0) -> Grid:
    return _scalar(src, N.divide(F.lit(float(scalar)), V()))


def power(src: Grid, scalar: float = 1) -> Grid:
    return _scalar(src, F.pow(V(), F.lit(float(scalar))))


def maximum_image_and_scalar(src: Grid, scalar: float = 0) -> Grid:
    return _scalar(src, N.fmax(V(), F.lit(float(scalar))))


def minimum_image_and_scalar(src: Grid, scalar: float = 0) -> Grid:
    return _scalar(src, N.fmin(V(), F.lit(float(scalar))))


def equal_constant(src: Grid, scalar: float = 0) -> Grid:
    return src.map(N.truth(V() == float(scalar), V()))


def not_equal_constant(src: Grid, scalar: float = 0) -> Grid:
    return src.map(1.0 - N.truth(V() == float(scalar), V()))


def greater_constant(src: Grid, scalar: float = 0) -> Grid:
    return src.map(N.truth(V() > float(scalar), V()))


def greater_or_equal_constant(src: Grid, scalar: float = 0) -> Grid:
    return src.map(N.truth(V() >= float(scalar), V()))


def smaller_constant(src: Grid, scalar: float = 0) -> Grid:
    return src.map(N.truth(V() < float(scalar), V()))


def smaller_or_equal_constant(src: Grid, scalar: float = 0) -> Grid:
    return src.map(N.truth(V() <= float(scalar), V()))


def clip(src: Grid, min_intensity: float = math.nan, max_intensity: float = math.nan) -> Grid:
    """Limits values; a NaN bound is the grid's own extreme, which limits nothing."""
    v = V()
    if not math.isnan(min_intensity):
        v = F.greatest(v, F.lit(float(min_intensity)))
    if not math.isnan(max_intensity):
        v = F.least(v, F.lit(float(max_intensity)))
    return src.map(v)


def gamma_correction(src: Grid, gamma: float = 1) -> Grid:
    """(v / m)^gamma * m with m the largest value."""
    top = with_totals(src, F.max("v").alias("m"))
    return top.map(F.pow(N.divide(V(), F.col("m")), F.lit(float(gamma))) * F.col("m"))


def multiply_image_and_position(src: Grid, dimension: int = 0) -> Grid:
    return src.map(V() * F.col(AXES[dimension]), FLOAT)


# -- generators and setters --------------------------------------------------


def create(spark, shape: tuple[int, ...], value: float = 0, dtype: str = FLOAT) -> Grid:
    """A new grid of one value."""
    return full(spark, shape, value, dtype)


def set(src: Grid, scalar: float = 0) -> Grid:
    return src.map(F.lit(float(scalar)))


def _where(src: Grid, where: Column, value: float) -> Grid:
    return src.map(F.when(where, float(value)).otherwise(V()))


def set_row(src: Grid, row_index: int = 0, value: float = 0) -> Grid:
    return _where(src, F.col("y") == row_index, value)


def set_column(src: Grid, column_index: int = 0, value: float = 0) -> Grid:
    return _where(src, F.col("x") == column_index, value)


def set_plane(src: Grid, plane_index: int = 0, value: float = 0) -> Grid:
    return _where(src, F.col("z") == plane_index, value)


def set_image_borders(src: Grid, value: float = 0) -> Grid:
    """Sets the outer faces of every axis longer than 1."""
    edge = F.lit(False)
    for axis, n in zip(AXES, src.shape, strict=True):
        if n > 1:
            edge = edge | (F.col(axis) == 0) | (F.col(axis) == n - 1)
    return _where(src, edge, value)


def set_ramp_x(src: Grid) -> Grid:
    return src.map(F.col("x"))


def set_ramp_y(src: Grid) -> Grid:
    return src.map(F.col("y"))


def set_ramp_z(src: Grid) -> Grid:
    return src.map(F.col("z"))


def set_where_x_equals_y(src: Grid, value: float = 0) -> Grid:
    return _where(src, F.col("x") == F.col("y"), value)


def set_where_x_greater_than_y(src: Grid, value: float = 0) -> Grid:
    return _where(src, F.col("x") > F.col("y"), value)


def set_where_x_smaller_than_y(src: Grid, value: float = 0) -> Grid:
    return _where(src, F.col("x") < F.col("y"), value)


def set_nonzero_pixels_to_pixelindex(src: Grid, offset: int = 1) -> Grid:
    return src.map(F.when(V() != 0, src.linear() + offset).otherwise(0), INDEX)


def replace_value(src: Grid, value_to_replace: float = 0, value_replacement: float = 1) -> Grid:
    return src.map(F.when(V() == float(value_to_replace), float(value_replacement)).otherwise(V()))
