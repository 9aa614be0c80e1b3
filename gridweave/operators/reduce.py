"""Whole-grid aggregates, axis projections, histograms and thresholds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import numeric as N
from gridweave.grid import BINARY, FLOAT, INDEX, KEYS, Grid
from gridweave.operators.binary import squared_difference
from gridweave.operators.coords import select_planes
from gridweave.operators.support import pair, V



def _one(df: DataFrame, *aggs: Column):
    return df.agg(*aggs).first()


def maximum_of_all_pixels(src: Grid) -> float:
    return _one(src.df, F.max("v"))[0]


def minimum_of_all_pixels(src: Grid) -> float:
    return _one(src.df, F.min("v"))[0]


def sum_of_all_pixels(src: Grid) -> float:
    return _one(src.df, F.sum("v"))[0]


def mean_of_all_pixels(src: Grid) -> float:
    return _one(src.df, F.avg("v"))[0]


def standard_deviation_of_all_pixels(src: Grid) -> float:
    return _one(src.df, F.stddev_pop("v"))[0]


def mean_squared_error(src0: Grid, src1: Grid) -> float:
    return _one(squared_difference(src0, src1).df, F.avg("v"))[0]


def jaccard_index(src0: Grid, src1: Grid) -> float:
    """Voxels set in both over voxels set in either."""
    a, b = F.col("v") != 0, F.col("w") != 0
    both, either = _one(pair(src0, src1), F.count_if(a & b), F.count_if(a | b))
    return both / either if either else math.nan


def array_equal(src0: Grid, src1: Grid) -> bool:
    return src0.shape == src1.shape and mean_squared_error(src0, src1) == 0


def maximum_position(src: Grid) -> list[float]:
    """(x, y, z) of the largest value, the first in plane, row and column."""
    at = _one(src.df, F.max_by(F.struct("x", "y", "z"), F.struct(V(), -F.col("z"), -F.col("y"), -F.col("x"))))[0]
    return [float(c) for c in at]


def minimum_position(src: Grid) -> list[float]:
    at = _one(src.df, F.min_by(F.struct("x", "y", "z"), F.struct(V(), "z", "y", "x")))[0]
    return [float(c) for c in at]


def minimum_of_masked_pixels(src: Grid, mask: Grid) -> float:
    return _one(pair(src, mask).filter("w != 0"), F.min("v"))[0]


def minimum_of_masked_pixels_reduction(src: Grid, mask: Grid) -> tuple[Grid, Grid]:
    """Minimum over z where the mask is set, and the mask's maximum over z."""
    w, h, _ = src.shape
    got = pair(src, mask).groupBy("y", "x").agg(F.min(F.when(F.col("w") != 0, V())).alias("v"), F.max("w").alias("m"))
    flat = got.select(F.lit(0).alias("z"), "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"), "m")
    return Grid(flat.select(*KEYS, "v"), (w, h, 1), src.dtype), Grid(flat.select(*KEYS, F.col("m").alias("v")), (w, h, 1), mask.dtype)


def bounding_box(src: Grid) -> list[float]:
    """Least x, y, z and greatest x, y, z of the non-zero voxels."""
    r = _one(src.df.filter(V() != 0), *(f(c) for f in (F.min, F.max) for c in ("x", "y", "z")))
    return [float(c or 0) for c in r]


def center_of_mass(src: Grid) -> list[float]:
    r = _one(src.df, *(F.sum(V() * F.col(c)) for c in ("x", "y", "z")), F.sum("v"))
    return [c / r[3] if r[3] else math.nan for c in r[:3]]


def label_bounding_box(src: Grid, label_id: int) -> list[float]:
    return bounding_box(Grid(src.df.filter(V() == label_id), src.shape, src.dtype))


# -- projections -------------------------------------------------------------

#: Keys that stay, and what they become, for a projection along each axis.
_KEPT = {"x": ("z", "y"), "y": ("x", "z"), "z": ("x", "y")}


def _project(src: Grid, axis: str, agg: Column, dtype: str | None = None) -> Grid:
    a, b = _KEPT[axis]
    got = src.df.groupBy(a, b).agg(agg.alias("v"))
    flat = got.select(F.lit(0).alias("z"), F.col(b).alias("y"), F.col(a).alias("x"), "v")
    size = dict(zip("xyz", src.shape, strict=True))
    return Grid(flat, (size[a], size[b], 1), src.dtype).map(V(), dtype)


_SIMPLE = {
    "maximum": (lambda: F.max("v"), None), "minimum": (lambda: F.min("v"), None), "mean": (lambda: F.avg("v"), None), "sum": (lambda: F.sum("v"), FLOAT),
    "std": (lambda: F.coalesce(F.stddev_samp("v"), F.lit(0.0)), FLOAT),
}


def _named(name: str, axis: str, agg: Callable[[], Column], dtype: str | None):
    def op(src: Grid) -> Grid:
        return _project(src, axis, agg(), dtype)

    op.__name__ = name
    op.__doc__ = f"{name.replace('_', ' ').capitalize()}; ties go to the first place."
    return op


for _axis in "xyz":
    for _kind, (_agg, _dtype) in _SIMPLE.items():
        globals()[f"{_kind}_{_axis}_projection"] = _named(f"{_kind}_{_axis}_projection", _axis, _agg, _dtype)
    for _kind, _agg in (("maximum", lambda a=_axis: F.max_by(a, F.struct(V(), -F.col(a)))), ("minimum", lambda a=_axis: F.min_by(a, F.struct("v", a)))):
        _name = f"{_axis}_position_of_{_kind}_{_axis}_projection"
        globals()[_name] = _named(_name, _axis, _agg, INDEX)


def z_position_projection(src: Grid, position: Grid) -> Grid:
    """For each (x, y) the value in the plane that ``position`` names."""
    return select_planes(src, position)


def sum_reduction_x(src: Grid, blocksize: int = 256) -> Grid:
    """Sums of whole blocks along x; floor(width / blocksize) of them."""
    w, h, d = src.shape
    n = w // blocksize
    block = F.floor(F.col("x") / blocksize).cast("int")
    got = src.df.groupBy("z", "y", block.alias("x")).agg(F.sum("v").alias("v")).filter(F.col("x") < n)
    return Grid(got, (max(1, n), h, d), src.dtype)


def block_enumerate(src0: Grid, src1: Grid | None = None, blocksize: int = 256) -> Grid:
    """Running number of the non-zero voxels along x, zeros stay 0.

    Two levels: counts inside blocks, and the sums of the blocks before (``src1``,
    or counted here), so no line is sorted in one task.
    """
    block = F.floor(F.col("x") / blocksize).cast("int")
    inner = W.partitionBy("z", "y", "block").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    rows = src0.df.withColumn("block", block).withColumn("run", F.sum("v").over(inner))
    if src1 is None:
        sums = src0.df.groupBy("z", "y", block.alias("block")).agg(F.sum("v").alias("s"))
    else:
        sums = src1.df.select("z", "y", F.col("x").alias("block"), F.col("v").alias("s"))
    before = W.partitionBy("z", "y").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("z", "y", "block", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("base"))
    out = rows.join(sums, ["z", "y", "block"], "left").select(*KEYS, (F.when(V() != 0, F.col("run") + F.coalesce("base", F.lit(0.0))).otherwise(0.0)).alias("v"))
    return Grid(out, src0.shape, FLOAT)


# -- histograms and thresholds ------------------------------------------------


def _binned(src: Grid, bins: int, lo: float, hi: float) -> DataFrame:
    """Voxels with ``lo``, ``hi`` and their bin; NaN bounds are the grid's own."""
    if math.isnan(lo) or math.isnan(hi):
        ends = src.df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        ends = ends.select(*(F.col(n) if math.isnan(x) else F.lit(float(x)).alias(n) for n, x in (("lo", lo), ("hi", hi))))
        rows = src.df.join(F.broadcast(ends))  # one row
    else:
        rows = src.df.withColumns({"lo": F.lit(float(lo)), "hi": F.lit(float(hi))})
    span = F.col("hi") - F.col("lo")
    at = F.when(span > 0, F.floor((V() - F.col("lo")) / F.when(span > 0, span).otherwise(1.0) * (bins - 1) + 0.5)).otherwise(0)
    return rows.filter((V() >= F.col("lo")) & (V() <= F.col("hi"))).withColumn("bin", at.cast("int"))


def histogram_table(src: Grid, num_bins: int = 256, lo: float = math.nan, hi: float = math.nan) -> DataFrame:
    """(bin, n, lo, hi) for every bin."""
    counts = _binned(src, num_bins, lo, hi).groupBy("bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    ends = counts.agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    bins = src.spark.range(num_bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(ends))
    return bins.join(counts.select("bin", "n"), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi")


def histogram(src: Grid, num_bins: int = 256, minimum_intensity: float = math.nan, maximum_intensity: float = math.nan) -> DataFrame:
    """(bin, n) for every bin of equal width between the two ends."""
    return histogram_table(src, num_bins, minimum_intensity, maximum_intensity).select("bin", "n")


def _otsu(src: Grid) -> DataFrame:
    """One row: threshold."""
    up = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # 256 rows
    down = W.orderBy("bin").rowsBetween(1, W.unboundedFollowing)
    h = histogram_table(src).withColumn("c", F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / 255.0)
    m = F.col("n") * F.col("c")
    h = h.select("bin", "c", F.sum("n").over(up).alias("w1"), F.sum("n").over(down).alias("w2"), F.sum(m).over(up).alias("s1"), F.sum(m).over(down).alias("s2"))
    ok = (F.col("w1") > 0) & (F.col("w2") > 0)
    h = h.filter(ok).withColumn("var", F.col("w1") * F.col("w2") * F.pow(F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2"), 2))
    return h.agg(F.max_by("c", F.struct(F.round("var", 6), -F.col("bin"))).alias("threshold"))


def _yen(src: Grid) -> DataFrame:
    up = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # 256 rows
    down = W.orderBy("bin").rowsBetween(1, W.unboundedFollowing)
    h = histogram_table(src)
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    h = h.withColumn("p", F.col("n") / total).withColumn("c", F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / 255.0)
    p2 = F.col("p") * F.col("p")
    h = h.select("bin", "c", F.sum("p").over(up).alias("p1"), F.sum(p2).over(up).alias("a"), F.sum(p2).over(down).alias("b"))
    fine = (F.col("a") * F.col("b") > 0) & (F.col("p1") * (1 - F.col("p1")) > 0)
    crit = F.when(fine, F.log(F.pow(F.col("p1") * (1 - F.col("p1")), 2) / F.when(fine, F.col("a") * F.col("b")).otherwise(1.0)))
    h = h.withColumn("crit", crit).filter("crit is not null")
    return h.agg(F.max_by("c", F.struct(F.round("crit", 9), -F.col("bin"))).alias("threshold"))


def _above(src: Grid, threshold: DataFrame) -> Grid:
    return Grid(src.df.join(F.broadcast(threshold)), src.shape, src.dtype).map(N.truth(V() > F.col("threshold"), V()), BINARY)


def threshold_mean(src: Grid) -> Grid:
    return _above(src, src.df.agg(F.avg("v").alias("threshold")))


def threshold_otsu(src: Grid) -> Grid:
    """1 above the threshold with the largest variance between the classes, first of equals."""
    return _above(src, _otsu(src))


def threshold_yen(src: Grid) -> Grid:
    return _above(src, _yen(src))


def percentile_table(src: Grid, percentile: float = 50.0) -> DataFrame:
    """One row (p): a percentile of the 256-bin histogram, linear inside its bin."""
    up = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # 256 rows
    h = histogram_table(src).withColumn("cum", F.sum("n").over(up)).withColumn("before", F.sum("n").over(up) - F.col("n"))
    total = F.max("cum").over(W.partitionBy(F.lit(0)))
    h = h.withColumn("target", total * F.lit(percentile / 100.0))
    hit = h.filter(F.col("cum") >= F.col("target")).agg(F.min_by(F.struct("bin", "cum", "before", "target", "lo", "hi"), "bin").alias("r")).select("r.*")
    step = (F.col("hi") - F.col("lo")) / 255.0
    part = F.when(F.col("cum") > F.col("before"), (F.col("target") - F.col("before")) / F.when(F.col("cum") > F.col("before"), F.col("cum") - F.col("before")).otherwise(1)).otherwise(0.0)
    value = F.when(F.col("bin") == 0, F.col("lo")).otherwise(F.col("lo") + (F.col("bin") - 1 + part) * step)
    return hit.select((value if src.dtype == FLOAT else F.round(value)).alias("p"))


def percentile(src: Grid, percentile: float = 50.0) -> float:
    return percentile_table(src, percentile).first()[0]


def normalize(src: Grid, low_percentile: float = -1, high_percentile: float = -1) -> Grid:
    """Maps [low, high] to [0, 1] and clips; the ends are extremes, or rounded percentiles where given and above 0."""
    lo = percentile_table(src, low_percentile).select(F.round("p").alias("lo")) if low_percentile > 0 else src.df.agg(F.min("v").alias("lo"))
    hi = percentile_table(src, high_percentile).select(F.round("p").alias("hi")) if high_percentile > 0 else src.df.agg(F.max("v").alias("hi"))
    rows = src.df.join(F.broadcast(lo)).join(F.broadcast(hi))  # one row each
    v = N.divide(V() - F.col("lo"), F.col("hi") - F.col("lo"))
    return Grid(rows, src.shape, src.dtype).map(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), FLOAT)
