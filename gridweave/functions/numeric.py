"""IEEE arithmetic on columns: what ANSI Spark would refuse or turn to null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN."""
    safe = a / F.when(b != 0, b).otherwise(1.0)
    return F.when(b != 0, safe).when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))


def remainder(a: Column, b: Column) -> Column:
    """C's fmod: the sign of the dividend, NaN for a zero divisor."""
    return F.when(b != 0, a % F.when(b != 0, b).otherwise(1.0)).otherwise(F.lit(NAN))


def logarithm(v: Column, log: Callable[[Column], Column] = F.log) -> Column:
    """-inf at 0, NaN below."""
    return F.when(v > 0, log(F.when(v > 0, v).otherwise(1.0))).when(v == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def fmax(a: Column, b: Column) -> Column:
    """The larger value; NaN only where both are."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def fmin(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def truth(condition: Column, *operands: Column) -> Column:
    """1 or 0; a comparison with NaN is 0."""
    for v in operands:
        condition = condition & ~F.isnan(v)
    return F.when(condition, 1.0).otherwise(0.0)


def truncate(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")
