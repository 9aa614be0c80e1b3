"""Two grids: equi-joins on the coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.functions import numeric as N
from gridweave.grid import FLOAT, Grid
from gridweave.operators.support import V as A
from gridweave.operators.support import W as B
from gridweave.operators.support import pair


BINARY: dict[str, tuple[Callable[[Column, Column], Column], str | None]] = {
    "add_images": (lambda a, b: a + b, FLOAT), "subtract_images": (lambda a, b: a - b, FLOAT), "multiply_images": (lambda a, b: a * b, None),
    "divide_images": (N.divide, None), "modulo_images": (N.remainder, None), "power_images": (F.pow, None),
    "maximum_images": (N.fmax, None), "minimum_images": (N.fmin, None), "absolute_difference": (lambda a, b: F.abs(a - b), None),
    "squared_difference": (lambda a, b: (a - b) * (a - b), FLOAT), "equal": (lambda a, b: N.truth(a == b, a, b), None),
    "not_equal": (lambda a, b: 1.0 - N.truth(a == b, a, b), None), "greater": (lambda a, b: N.truth(a > b, a, b), None),
    "greater_or_equal": (lambda a, b: N.truth(a >= b, a, b), None), "smaller": (lambda a, b: N.truth(a < b, a, b), None),
    "smaller_or_equal": (lambda a, b: N.truth(a <= b, a, b), None),
    "binary_and": (lambda a, b: F.when((a != 0) & (b != 0), 1.0).otherwise(0.0), None),
    "binary_or": (lambda a, b: F.when((a != 0) | (b != 0), 1.0).otherwise(0.0), None),
    "binary_xor": (lambda a, b: F.when((a != 0) != (b != 0), 1.0).otherwise(0.0), None),
    "binary_subtract": (lambda a, b: F.when((a != 0) & (b == 0), 1.0).otherwise(0.0), None),
    "mask": (lambda a, b: F.when(b != 0, a).otherwise(0.0), None),
}


def apply(a: Grid, b: Grid, v: Column, dtype: str | None = None) -> Grid:
    """A function of the values ``v`` of a and ``w`` of b."""
    return Grid(pair(a, b), a.shape, a.dtype).map(v, dtype)


def _binary(name: str, f: Callable[[Column, Column], Column], dtype: str | None) -> Callable[[Grid, Grid], Grid]:
    def op(src0: Grid, src1: Grid) -> Grid:
        return apply(src0, src1, f(A(), B()), dtype)

    op.__name__ = name
    op.__doc__ = f"{name.replace('_', ' ').capitalize()}, voxel by voxel."
    return op


globals().update({name: _binary(name, *how) for name, how in BINARY.items()})


def add_images_weighted(src0: Grid, src1: Grid, factor1: float = 1, factor2: float = 1) -> Grid:
    return apply(src0, src1, A() * float(factor1) + B() * float(factor2), FLOAT)


def mask_label(src0: Grid, src1: Grid, label: float = 1) -> Grid:
    """Values where the label is ``label``, else 0."""
    return apply(src0, src1, F.when(B() == float(label), A()).otherwise(0.0))
