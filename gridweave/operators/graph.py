"""Graphs of labels and points as sparse relations (i, j, v)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import numeric as N
from gridweave.grid import AXES, Grid
from gridweave.operators.filters import line
from gridweave.operators.labels import centroids_of_labels, dilate_labels, paint
from gridweave.operators.support import pair, V



def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", "v").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def _contacts(src: Grid) -> DataFrame:
    """(i, j, v) with i < j: faces that two labels share, background included."""
    out = None
    for axis, n in zip(AXES, src.shape, strict=True):
        if n > 1:
            part = src.df.select(V().alias("a"), F.lead("v").over(line(axis)).alias("b")).filter("a != b")
            part = part.groupBy(F.least("a", "b").cast("long").alias("i"), F.greatest("a", "b").cast("long").alias("j")).agg(F.count("*").alias("v"))
            out = part if out is None else out.union(part)
    return out.groupBy("i", "j").agg(F.sum("v").cast("double").alias("v"))


def touching_pairs(src: Grid) -> DataFrame:
    return _contacts(src).select("i", "j")


def generate_touch_matrix(src: Grid) -> DataFrame:
    """1 for each pair of labels that share a face, both ways round."""
    return mirrored(_contacts(src).select("i", "j", F.lit(1.0).alias("v")))


def generate_touching_area_matrix(src: Grid) -> DataFrame:
    """Number of faces that two labels share, both ways round."""
    return mirrored(_contacts(src))


def generate_binary_overlap_matrix(src0: Grid, src1: Grid) -> DataFrame:
    """1 where label i of the first and j of the second share a voxel."""
    return pair(src0, src1).select(V().cast("long").alias("i"), F.col("w").cast("long").alias("j")).distinct().withColumn("v", F.lit(1.0))


def generate_partial_touching_area_matrix(src: Grid) -> DataFrame:
    """Shared faces as a part of all faces of label i."""
    area = generate_touching_area_matrix(src)
    return area.select("i", "j", (V() / F.sum("v").over(W.partitionBy("i"))).alias("v"))


def generate_partial_touching_area_matrix_within_range(matrix: DataFrame, min_distance: float = 0, max_distance: float = 1.1) -> DataFrame:
    return matrix.filter((V() > min_distance) & (V() < max_distance)).select("i", "j", F.lit(1.0).alias("v"))


def generate_distance_matrix(points0: DataFrame, points1: DataFrame) -> DataFrame:
    """Euclidean distance of each pair of two lists (id, x, y, z); i and j are id + 1.

    All pairs are what is asked for; where a range is enough,
    ``proximal_pairs`` looks only at near cells.
    """
    a = points0.select((F.col("id") + 1).alias("i"), *(F.col(c).alias(f"{c}0") for c in AXES))
    b = points1.select((F.col("id") + 1).alias("j"), *(F.col(c).alias(f"{c}1") for c in AXES))
    d = F.sqrt(sum((F.pow(F.col(f"{c}0") - F.col(f"{c}1"), 2) for c in AXES), F.lit(0.0)))
    return a.crossJoin(b).select("i", "j", d.alias("v"))


def generate_proximal_neighbors_matrix(distances: DataFrame, min_distance: float = -1, max_distance: float = -1) -> DataFrame:
    """1 where min <= distance <= max between two different labels; negative bounds are open."""
    ok = (F.col("i") != F.col("j")) & (F.col("i") > 0) & (F.col("j") > 0)
    if min_distance >= 0:
        ok = ok & (V() >= min_distance)
    if max_distance >= 0:
        ok = ok & (V() <= max_distance)
    return distances.filter(ok).select("i", "j", F.lit(1.0).alias("v"))


def proximal_pairs(points: DataFrame, min_distance: float, max_distance: float) -> DataFrame:
    """(i, j, v): distances of pairs (label, x, y, z) inside a range, found through cells as wide as the range."""
    if max_distance < 0:
        p = points.select((F.col("label") - 1).alias("id"), *AXES)
        d = generate_distance_matrix(p, p).filter("i != j")
    else:
        size = max(max_distance, 1e-9)
        cell = [F.floor(F.col(a) / size).alias(f"c{a}") for a in AXES]
        left = points.select(F.col("label").alias("i"), *(F.col(a).alias(f"{a}0") for a in AXES), *cell)
        near = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1))))
        right = points.select(F.col("label").alias("j"), *(F.col(a).alias(f"{a}1") for a in AXES), *cell, near.alias("o"))
        right = right.select("j", *(f"{a}1" for a in AXES), *((F.col(f"c{a}") + F.col("o")[a]).alias(f"c{a}") for a in AXES))
        d = F.sqrt(sum((F.pow(F.col(f"{c}0") - F.col(f"{c}1"), 2) for c in AXES), F.lit(0.0)))
        d = left.join(right, ["cx", "cy", "cz"]).filter("i != j").select("i", "j", d.alias("v")).filter(V() <= max_distance)
    return d.filter(V() >= min_distance) if min_distance >= 0 else d


def count_touching_neighbors(touch: DataFrame, ignore_background: bool = True) -> DataFrame:
    """(label, v): neighbours of each label."""
    rows = touch.filter("v != 0 AND i != j")
    if ignore_background:
        rows = rows.filter("i != 0 AND j != 0")
    return rows.groupBy(F.col("i").alias("label")).agg(F.count("*").cast("double").alias("v"))


def _symmetric(matrix: DataFrame, f) -> DataFrame:
    other = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), V().alias("w"))
    zero = F.lit(0.0)
    return matrix.select("i", "j", "v").join(other, ["i", "j"], "full").select("i", "j", f(F.coalesce("v", zero), F.coalesce("w", zero)).alias("v"))


def symmetric_maximum_matrix(matrix: DataFrame) -> DataFrame:
    return _symmetric(matrix, F.greatest)


def symmetric_minimum_matrix(matrix: DataFrame) -> DataFrame:
    return _symmetric(matrix, F.least)


def symmetric_mean_matrix(matrix: DataFrame) -> DataFrame:
    return _symmetric(matrix, lambda a, b: (a + b) / 2)


def standard_deviation_partial_touching_area_matrix(src: Grid) -> DataFrame:
    """(label, v): mean distance of the portions of a label from equal ones, background 0."""
    p = generate_partial_touching_area_matrix(src)
    k = F.count("*").over(W.partitionBy("i"))
    p = p.withColumn("k", k).groupBy(F.col("i").alias("label")).agg(F.sum(F.abs(V() - 1 / F.col("k")) / F.col("k")).alias("v"))
    return p.withColumn("v", F.when(F.col("label") == 0, 0.0).otherwise(V()))


# -- values of neighbours ------------------------------------------------------------


def reach(touch: DataFrame, radius: int = 1, ignore_background: bool = True) -> DataFrame:
    """(i, j) of labels at most ``radius`` contacts apart, without self."""
    one = touch.filter("v != 0 AND i != j").select("i", "j")
    if ignore_background:
        one = one.filter("i != 0 AND j != 0")
    out = one
    for _ in range(radius - 1):
        step = out.select("i", F.col("j").alias("m")).join(one.select(F.col("i").alias("m"), "j"), "m").select("i", "j")
        out = out.union(step).filter("i != j").distinct()
    return out.distinct()


def _near_values(values: DataFrame, touch: DataFrame, itself: bool, radius: int, ignore_background: bool) -> DataFrame:
    """(label, v): the values of the labels that touch each label."""
    near = reach(touch, radius, ignore_background)
    if itself:
        own = values.filter("label != 0") if ignore_background else values
        near = near.union(own.select(F.col("label").alias("i"), F.col("label").alias("j")))
    return near.join(values.select(F.col("label").alias("j"), "v"), "j").select(F.col("i").alias("label"), "v")


def _of_neighbors(values: DataFrame, touch: DataFrame, agg: Column, itself: bool, radius: int = 1, ignore_background: bool = True) -> DataFrame:
    """(label, v) from a table (label, v): an aggregate over the touching labels."""
    return _near_values(values, touch, itself, radius, ignore_background).groupBy("label").agg(agg.alias("v"))


def mean_of_touching_neighbors(values: DataFrame, touch: DataFrame, radius: int = 1, ignore_background: bool = True) -> DataFrame:
    return _of_neighbors(values, touch, F.avg("v"), True, radius, ignore_background)


def median_of_touching_neighbors(values: DataFrame, touch: DataFrame, radius: int = 1, ignore_background: bool = True) -> DataFrame:
    near = _near_values(values, touch, True, radius, ignore_background)
    own = W.partitionBy("label")  # sorted on disk where a label has very many neighbours
    ranked = near.select("label", "v", F.row_number().over(own.orderBy("v")).alias("r"), F.count("*").over(own).alias("n"))
    return ranked.filter(F.col("r") == F.floor(F.col("n") / 2) + 1).select("label", "v")


def minimum_of_touching_neighbors(values: DataFrame, touch: DataFrame, radius: int = 1, ignore_background: bool = True) -> DataFrame:
    return _of_neighbors(values, touch, F.min("v"), True, radius, ignore_background)


def maximum_of_touching_neighbors(values: DataFrame, touch: DataFrame, radius: int = 1, ignore_background: bool = True) -> DataFrame:
    return _of_neighbors(values, touch, F.max("v"), True, radius, ignore_background)


def standard_deviation_of_touching_neighbors(values: DataFrame, touch: DataFrame, radius: int = 1, ignore_background: bool = True) -> DataFrame:
    """Root of the squared deviations over the width of the matrix (labels and background)."""
    width = values.agg((F.max("label") + 1).alias("m"))
    got = _of_neighbors(values, touch, F.var_pop("v") * F.count("v"), True, radius, ignore_background)
    return got.join(F.broadcast(width)).select("label", F.sqrt(V() / F.col("m")).alias("v"))


def mode_of_touching_neighbors(values: DataFrame, touch: DataFrame, radius: int = 1, ignore_background: bool = True) -> DataFrame:
    """The most frequent value of the others, the smallest of equals."""
    return _of_neighbors(values, touch, F.mode("v", True), False, radius, ignore_background)


def _map(f):
    def op(map: Grid, labels: Grid, radius: int = 1, ignore_background: bool = True) -> Grid:  # noqa: A002
        from gridweave.operators.labels import read_map_values

        return paint(labels, f(read_map_values(map, labels), generate_touch_matrix(labels), radius, ignore_background))

    op.__name__ = f.__name__ + "_map"
    op.__doc__ = f"``{f.__name__}`` of a map, painted on the labels."
    return op


mean_of_touching_neighbors_map = _map(mean_of_touching_neighbors)
median_of_touching_neighbors_map = _map(median_of_touching_neighbors)
minimum_of_touching_neighbors_map = _map(minimum_of_touching_neighbors)
maximum_of_touching_neighbors_map = _map(maximum_of_touching_neighbors)
standard_deviation_of_touching_neighbors_map = _map(standard_deviation_of_touching_neighbors)
mode_of_touching_neighbors_map = _map(mode_of_touching_neighbors)


def touching_neighbor_count_map(labels: Grid) -> Grid:
    return paint(labels, count_touching_neighbors(generate_touch_matrix(labels)))


def _touching_distance(distances: DataFrame, touch: DataFrame, agg: Column) -> DataFrame:
    near = touch.filter("v != 0 AND i != j AND i != 0 AND j != 0").select("i", "j")
    return near.join(distances.select("i", "j", "v"), ["i", "j"]).groupBy(F.col("i").alias("label")).agg(agg.alias("v"))


def minimum_distance_touching_neighbors(distances: DataFrame, touch: DataFrame) -> DataFrame:
    return _touching_distance(distances, touch, F.min("v"))


def maximum_distance_touching_neighbors(distances: DataFrame, touch: DataFrame) -> DataFrame:
    return _touching_distance(distances, touch, F.max("v"))


def mean_distance_touching_neighbors(distances: DataFrame, touch: DataFrame) -> DataFrame:
    return _touching_distance(distances, touch, F.avg("v"))


def _nearest(distances: DataFrame, n: int, agg: Column, far: bool = False) -> DataFrame:
    rows = distances.filter("i != j AND i > 0 AND j > 0")
    order = W.partitionBy("i").orderBy(V().desc() if far else V().asc(), "j")
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).groupBy(F.col("i").alias("label")).agg(agg.alias("v"))


def mean_distance_n_nearest_neighbors(distances: DataFrame, n: int = 1) -> DataFrame:
    return _nearest(distances, n, F.avg("v"))


def maximum_distance_n_nearest_neighbors(distances: DataFrame, n: int = 1) -> DataFrame:
    return _nearest(distances, n, F.max("v"))


def mean_distance_n_farthest_neighbors(distances: DataFrame, n: int = 1) -> DataFrame:
    return _nearest(distances, n, F.avg("v"), True)


def proximal_neighbor_count(src: Grid, min_distance: float = -1, max_distance: float = -1) -> DataFrame:
    """(label, v): labels whose centroids are inside a range of distances."""
    c = centroids_of_labels(src)
    n = proximal_pairs(c, min_distance, max_distance).groupBy(F.col("i").alias("label")).agg(F.count("*").cast("double").alias("v"))
    return c.select("label").join(n, "label", "left").select("label", F.coalesce("v", F.lit(0.0)).alias("v"))


def proximal_neighbor_count_map(labels: Grid, min_distance: float = -1, max_distance: float = -1) -> Grid:
    return paint(labels, proximal_neighbor_count(labels, min_distance, max_distance), dtype="UINT32")


def multiply_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of relations (i row, j column, v)."""
    left = a.select("i", F.col("j").alias("k"), V().alias("a"))
    right = b.select(F.col("i").alias("k"), "j", V().alias("b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def centroid_distances(labels: Grid) -> DataFrame:
    """(i, j, v): distances between the centroids of all labels."""
    p = centroids_of_labels(labels).select((F.col("label") - 1).alias("id"), *AXES)
    return generate_distance_matrix(p, p)


# The portions from which neighbours are counted.
PORTIONS = (0, 0.16, 0.2, 0.33, 0.5, 0.75)


def _touch_statistics(labels: Grid, distances: DataFrame, suffix: str = "") -> list[tuple[str, DataFrame]]:
    touch, area = generate_touch_matrix(labels), generate_touching_area_matrix(labels)
    inner = area.filter("i != 0 AND j != 0")
    part = generate_partial_touching_area_matrix(labels)
    own = part.filter("i != 0 AND j != 0").groupBy(F.col("i").alias("label"))
    out = [
        (f"touching_neighbor_count{suffix}", count_touching_neighbors(touch)), (f"minimum_distance_of_touching_neighbors{suffix}", minimum_distance_touching_neighbors(distances, touch)),
        (f"average_distance_of_touching_neighbors{suffix}", mean_distance_touching_neighbors(distances, touch)), (f"maximum_distance_of_touching_neighbors{suffix}", maximum_distance_touching_neighbors(distances, touch)),
    ]
    if not suffix:
        out += [(f"touch_portion_above_{t:.6f}_neighbor_count", own.agg(F.count_if(V() > t).cast("double").alias("v"))) for t in PORTIONS]
    by = inner.groupBy(F.col("i").alias("label"))
    out += [(f"touch_count_sum{suffix}", by.agg(F.sum("v").alias("v"))), (f"minimum_touch_count{suffix}", by.agg(F.min("v").alias("v"))), (f"maximum_touch_count{suffix}", by.agg(F.max("v").alias("v")))]
    out += [(f"minimum_touch_portion{suffix}", own.agg(F.min("v").alias("v"))), (f"maximum_touch_portion{suffix}", own.agg(F.max("v").alias("v")))]
    out.append((f"standard_deviation_touch_portion{suffix}", standard_deviation_partial_touching_area_matrix(labels)))
    return out


def labels_neighbors_statistics(label: Grid, proximal_distances: tuple[float, ...] = (10, 20, 40, 80, 160), nearest_neighbor_ns: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7, 8, 10, 20), dilation_radii: tuple[int, ...] = (5, 10), include_background: bool = False) -> DataFrame:
    """Touching, proximal, nearest and dilated neighbourhood of each label, one row per label."""
    distances = centroid_distances(label)
    columns = _touch_statistics(label, distances)
    columns += [(f"proximal_neighbor_count_d{d:g}", proximal_neighbor_count(label, -1, d)) for d in proximal_distances]
    for n in nearest_neighbor_ns:
        columns += [(f"maximum_distance_of_n{n}_nearest_neighbors", maximum_distance_n_nearest_neighbors(distances, n)), (f"average_distance_of_n{n}_nearest_neighbors", mean_distance_n_nearest_neighbors(distances, n))]
    columns.append(("distance_to_most_distant_other", distances.filter("i != j").groupBy(F.col("i").alias("label")).agg(F.max("v").alias("v"))))
    for r in dilation_radii:
        columns += _touch_statistics(dilate_labels(label, r), distances, f"_dilated_r_{r}")
    out = label.df.select(V().cast("long").alias("label")).distinct()
    out = out if include_background else out.filter("label > 0")
    for name, table in columns:
        out = out.join(table.select("label", V().alias(name)), "label", "left")
    out = out.na.fill(0.0)
    ratio = N.divide(F.col("maximum_distance_of_touching_neighbors"), F.col("minimum_distance_of_touching_neighbors"))
    return out.withColumn("max_min_distance_ratio_of_touching_neighbors", F.when(F.isnan(ratio), 0.0).otherwise(ratio))


