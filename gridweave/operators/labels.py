"""Labels: lookup, relabelling, components, growth, filtering, statistics."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridweave.functions import numeric as N
from gridweave.grid import AXES, BINARY, FLOAT, KEYS, LABEL, Grid, densify
from gridweave.operators import binary
from gridweave.operators.filters import cross, detect_maxima, faces, gaussian_blur, minimum_filter
from gridweave.operators.morphology import binary_erode
from gridweave.operators.pointwise import greater_constant
from gridweave.operators.reduce import threshold_otsu
from gridweave.operators.support import cut, pair, V
from gridweave.plans.tiles import TILE, stencil


# -- lookup and relabelling ------------------------------------------------------


def paint(labels: Grid, table: DataFrame, value: str = "v", dtype: str = FLOAT, missing: float = 0.0) -> Grid:
    """Each label's value of a table (label, value) at its voxels; others get ``missing``."""
    t = table.select(F.col("label").cast("double").alias("v"), F.col(value).cast("double").alias("_p"))
    return Grid(labels.df.join(t, "v", "left").select(*KEYS, "_p"), labels.shape, dtype).map(F.coalesce("_p", F.lit(float(missing))), dtype)


def replace_values(src: Grid, table: DataFrame) -> Grid:
    """v' = table[v]; ``table`` has (label, v) for every value that occurs."""
    return paint(src, table, "v", src.dtype)


def numbered(ids: DataFrame) -> DataFrame:
    """(label, new): distinct labels numbered 1.. in ascending order.

    Ranges of labels are numbered each for itself, after one row for each range
    has told how many come before it.
    """
    ranged = ids.distinct().repartitionByRange("label").select("label", F.spark_partition_id().alias("part"))
    ranged = cut(ranged)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(W.partitionBy("part").orderBy("label"))
    return ranged.join(F.broadcast(sizes), "part").select("label", (nth + F.col("base")).alias("new"))


def relabel_sequential(src: Grid) -> Grid:
    """Closes the gaps between label ids; their order stays, background is 0."""
    ids = src.df.filter(V() != 0).select(V().alias("label"))
    return paint(src, numbered(ids), "new", src.dtype)


#: Ids of an array that is made at once.
IDS = 1 << 16


def ids_up_to(top: DataFrame, first: int) -> DataFrame:
    """(label) from ``first`` to the one number ``top``, in pieces of bounded size."""
    last = F.col("top").cast("long")
    pieces = top.filter(last >= first).select(last.alias("top"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / IDS))).alias("piece"))
    begin, end = F.greatest(F.col("piece") * IDS, F.lit(first).cast("long")), F.least(F.col("piece") * IDS + IDS - 1, F.col("top"))
    return pieces.filter(begin <= end).select(F.explode(F.sequence(begin, end)).alias("label"))


def flag_existing_labels(src: Grid) -> DataFrame:
    """(label, v) from 0 to the largest label: 1 where it occurs."""
    seen = src.df.select(V().cast("long").alias("label")).distinct().withColumn("v", F.lit(1.0))
    all_ = ids_up_to(seen.agg(F.max("label").alias("top")), 0)
    return all_.join(seen, "label", "left").select("label", F.coalesce("v", F.lit(0.0)).alias("v"))


def read_map_values(map: Grid, label: Grid) -> DataFrame:  # noqa: A002
    """(label, v): what a map holds at each label (the largest, where it differs)."""
    return pair(label, map).groupBy(V().cast("long").alias("label")).agg(F.max("w").alias("v"))


def labelled_spots_to_pointlist(label: Grid) -> DataFrame:
    """(id, x, y, z) of each label's voxel, id from 0."""
    return label.df.filter(V() > 0).groupBy((V() - 1).cast("long").alias("id")).agg(*(F.max(a).alias(a) for a in AXES))


def label_spots(src: Grid) -> Grid:
    """Numbers the non-zero voxels 1.. in x-fastest order."""
    at = src.df.filter(V() != 0).select(src.linear().alias("label"))
    n = numbered(at).select(F.col("label").alias("_i"), "new")
    rows = src.df.withColumn("_i", src.linear()).join(n, "_i", "left")
    return Grid(rows, src.shape, LABEL).map(F.coalesce("new", F.lit(0)), LABEL)


def spots_to_pointlist(src: Grid) -> DataFrame:
    return labelled_spots_to_pointlist(label_spots(src))


def pointlist_to_labelled_spots(points: DataFrame, shape: tuple[int, int, int]) -> Grid:
    """Point ``id`` (id, x, y, z) becomes label id + 1 at its truncated place."""
    at = points.select(*(F.floor(c).cast("int").alias(c) for c in AXES), (F.col("id") + 1).cast("double").alias("v"))
    return densify(at.groupBy(*KEYS).agg(F.max("v").alias("v")), shape, 0.0, LABEL)


def detect_label_edges(src: Grid) -> Grid:
    """1 where a face neighbour has another label."""
    df = cross(src)
    other = F.lit(False)
    for c in faces(df):
        other = other | (c != V())
    return Grid(df, src.shape, src.dtype).map(F.when(other, 1.0).otherwise(0.0), BINARY)


def reduce_labels_to_label_edges(src: Grid) -> Grid:
    return binary.apply(src, detect_label_edges(src), F.when(F.col("w") != 0, V()).otherwise(0.0))


def centroids_of_labels(src: Grid, include_background: bool = False) -> DataFrame:
    """(label, x, y, z): mean coordinates."""
    rows = src.df if include_background else src.df.filter(V() != 0)
    return rows.groupBy(V().cast("long").alias("label")).agg(*(F.avg(a).alias(a) for a in AXES))


def reduce_labels_to_centroids(src: Grid) -> Grid:
    at = centroids_of_labels(src).select(*(F.floor(c).cast("int").alias(c) for c in AXES), F.col("label").cast("double").alias("v"))
    return densify(at.groupBy(*KEYS).agg(F.max("v").alias("v")), src.shape, 0.0, LABEL)


# -- components -------------------------------------------------------------------


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of (a, b): the smallest node of each component."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct())
    label = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("w"), F.first("u")).alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("w"), F.col("label").alias("far")), "w").groupBy(F.col("u").alias("node")).agg(F.min("far").alias("far"))
        step = label.join(near, "node").select("node", "label", F.least("label", "far").alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("label").alias("next"))
        step = cut(step.join(jump, "new", "left").select("node", "label", F.least("new", "next").alias("new")))
        if step.filter("new != label").isEmpty():
            return label
        label = step.select("node", F.col("new").alias("label"))


def _forward(connectivity: str) -> list[tuple[int, int, int]]:
    if connectivity == "sphere":
        return [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    return [(z, y, x) for z in (0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) > (0, 0, 0)]


def _local(box: np.ndarray, connectivity: str, index: np.ndarray) -> np.ndarray:
    """Components of one block: each voxel gets the smallest index of its component, background -1."""
    on = box != 0
    big = np.iinfo(np.int64).max
    lab = np.where(on, np.arange(box.size).reshape(box.shape), big)
    steps = _forward(connectivity)
    while True:
        old = lab.copy()
        for dz, dy, dx in steps:
            a = tuple(slice(max(0, -o), n - max(0, o)) for o, n in zip((dz, dy, dx), box.shape, strict=True))
            b = tuple(slice(max(0, o), n - max(0, -o)) for o, n in zip((dz, dy, dx), box.shape, strict=True))
            if all(s.stop > s.start for s in a):
                low = np.where(on[a] & on[b], np.minimum(lab[a], lab[b]), big)
                lab[a] = np.where(on[a], np.minimum(lab[a], low), lab[a])
                lab[b] = np.where(on[b], np.minimum(lab[b], low), lab[b])
        flat = lab.ravel()
        lab = np.where(on, flat[np.minimum(lab, box.size - 1)], big)
        if (lab == old).all():
            return np.where(on, index.ravel()[np.minimum(lab, box.size - 1)], -1)


def connected_component_labeling(src: Grid, connectivity: str = "box", tile: tuple[int, int, int] = TILE) -> Grid:
    """Components of the non-zero voxels, numbered by their first voxel in x-fastest order.

    Blocks are labelled each for itself; then only pairs of block labels that
    meet at block borders are joined, so the loop runs over labels and not over
    voxels.
    """
    w, h, d = src.shape
    t = tuple(min(a, n) for a, n in zip(tile, src.shape, strict=True))

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z, y, x = (pdf[k].to_numpy() for k in KEYS)
        z0, y0, x0 = z.min(), y.min(), x.min()
        box = np.zeros((z.max() - z0 + 1, y.max() - y0 + 1, x.max() - x0 + 1))
        index = np.zeros(box.shape, np.int64)
        at = (z - z0, y - y0, x - x0)
        box[at] = pdf["v"]
        index[at] = x + w * (y.astype(np.int64) + h * z.astype(np.int64))
        pdf["v"] = _local(box, connectivity, index)[at].astype(float)
        return pdf[[*KEYS, "v"]]

    tiles = [F.floor(F.col(a) / n).alias(f"t{a}") for a, n in zip(AXES, t, strict=True)]
    rows = cut(src.df.groupBy(*tiles).applyInPandas(local, "z int, y int, x int, v double"))
    border = F.lit(False)
    for a, n, size in zip(AXES, t, src.shape, strict=True):
        if n < size:
            border = border | (F.col(a) % n == 0) | (F.col(a) % n == n - 1)
    edge = rows.filter((V() >= 0) & border)
    ways = F.explode(F.array(*(F.struct(F.lit(z).alias("z"), F.lit(y).alias("y"), F.lit(x).alias("x")) for z, y, x in _forward(connectivity))))
    near = edge.select(*KEYS, V().alias("a"), ways.alias("o")).select(*((F.col(k) + F.col("o")[k]).alias(k) for k in KEYS), "a")
    edges = near.join(edge.withColumnRenamed("v", "b"), KEYS).filter("a != b").select("a", "b").distinct()
    found = connected(edges).withColumnRenamed("node", "v")
    rows = rows.join(found, "v", "left").select(*KEYS, F.when(V() >= 0, F.coalesce("label", V()) + 1).otherwise(0.0).alias("v"))
    return relabel_sequential(Grid(rows, src.shape, LABEL))


# -- growth ------------------------------------------------------------------------


def _grow_block(block: np.ndarray, steps: int, first: int) -> np.ndarray:
    for i in range(first, first + steps):
        padded = np.pad(block, 1, mode="edge")
        best = block.copy()
        if i % 2 == 0:
            for axis in range(3):
                n = block.shape[axis]
                p = np.pad(best, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="edge")
                best = np.maximum(np.maximum(np.take(p, range(n), axis), best), np.take(p, range(2, n + 2), axis))
        else:
            for axis in range(3):
                n = block.shape[axis]
                mid = [slice(1, -1)] * 3
                for o in (0, 2):
                    mid[axis] = slice(o, o + n)
                    best = np.maximum(best, padded[tuple(mid)])
        block = np.where(block == 0, best, block)
    return block


#: Growth steps of one pass over the tiles.
PASS = 8


def _grow(src: Grid, steps: int | None = None) -> Grid:
    """Alternating box and sphere growth into zeros, for some steps or until nothing changes.

    Each pass makes up to ``PASS`` steps inside tiles whose halo is as wide.
    """
    done, out = 0, src
    while steps is None or done < steps:
        k = PASS if steps is None else min(PASS, steps - done)
        radius = tuple(k if n > 1 else 0 for n in src.shape)
        first = done

        def fn(b: np.ndarray, k: int = k, first: int = first, r: tuple = radius) -> np.ndarray:
            grown = _grow_block(b, k, first)
            return grown[tuple(slice(m, n - m) for m, n in zip(r[::-1], b.shape, strict=True))]

        new = Grid(cut(stencil(out, radius, fn, FLOAT).df), src.shape, out.dtype)
        done += k
        if steps is None and pair(out, new).filter("v != w").isEmpty():
            return new
        out = new
    return out


def extend_labeling_via_voronoi(src: Grid) -> Grid:
    """Grows labels into zeros until there are none; of two labels that meet, the larger wins."""
    return _grow(src).map(V(), LABEL)


def dilate_labels(src: Grid, radius: int = 2) -> Grid:
    return src.map(V(), LABEL) if radius <= 0 else _grow(src, radius).map(V(), LABEL)


def erode_labels(src: Grid, radius: int = 1, relabel: bool = False) -> Grid:
    """Drops label edges, then takes minima (sphere and box in turn); may split labels anew."""
    if radius <= 0:
        return src.map(V(), LABEL)
    out = binary.apply(src, detect_label_edges(src), F.when(F.col("w") == 0, V()).otherwise(0.0))
    for i in range(radius - 1):
        out = minimum_filter(out, 1, 1, 1, "sphere" if i % 2 == 0 else "box")
    out = out.map(V(), LABEL)
    if relabel:
        return connected_component_labeling(out.map(F.when(V() != 0, 1.0).otherwise(0.0)), "sphere")
    return relabel_sequential(out)


def voronoi_labeling(src: Grid) -> Grid:
    return extend_labeling_via_voronoi(connected_component_labeling(src, "box"))


def masked_voronoi_labeling(src: Grid, mask: Grid) -> Grid:
    """Components of ``src``, grown inside the mask."""
    seeds = connected_component_labeling(src, "box")
    start = binary.apply(seeds, mask, V() + F.col("w") - 1, FLOAT)
    return binary.apply(_grow(start), mask, F.when(F.col("w") != 0, V()).otherwise(0.0)).map(V(), LABEL)


def gauss_otsu_labeling(src: Grid, outline_sigma: float = 0) -> Grid:
    return connected_component_labeling(threshold_otsu(gaussian_blur(src, *[outline_sigma] * 3)), "box")


def voronoi_otsu_labeling(src: Grid, spot_sigma: float = 2, outline_sigma: float = 2) -> Grid:
    """Maxima of a blur inside the Otsu mask of a blur, grown over the mask."""
    spots = detect_maxima(gaussian_blur(src, *[spot_sigma] * 3), 0, 0, 0, "box")
    outline = Grid(cut(threshold_otsu(gaussian_blur(src, *[outline_sigma] * 3)).df), src.shape, BINARY)
    seeds = binary.apply(spots, outline, F.when((V() != 0) & (F.col("w") != 0), 1.0).otherwise(0.0))
    return masked_voronoi_labeling(seeds, outline)


def eroded_otsu_labeling(src: Grid, number_of_erosions: int = 5, outline_sigma: float = 2) -> Grid:
    mask = Grid(cut(threshold_otsu(gaussian_blur(src, *[outline_sigma] * 3)).df), src.shape, BINARY)
    eroded = binary_erode(mask, *[number_of_erosions] * 3, "box") if number_of_erosions > 0 else mask  # boxes add up
    return masked_voronoi_labeling(eroded, mask)


def closing_labels(src: Grid, radius: int = 0) -> Grid:
    """Dilates, then erodes the foreground as often, sphere and box in turn."""
    if radius <= 0:
        return src.map(V(), LABEL)
    grown = dilate_labels(src, radius)
    keep = greater_constant(grown, 0)
    for i in range(radius):
        keep = binary_erode(keep, 1, 1, 1, "sphere" if i % 2 == 0 else "box")
    return binary.apply(keep, grown, V() * F.col("w"), LABEL)


def opening_labels(src: Grid, radius: int = 0) -> Grid:
    return dilate_labels(erode_labels(src, radius, False), radius)


def erode_connected_labels(src: Grid, radius: int = 1) -> Grid:
    """Erodes the foreground as one; labels keep what is left of them."""
    if radius < 1:
        return src.map(V(), LABEL)
    eroded = erode_labels(greater_constant(src, 0), radius, False)
    return relabel_sequential(binary.apply(src, eroded, V() * F.col("w"), LABEL))


def smooth_labels(src: Grid, radius: int = 0) -> Grid:
    """Opens, grows over everything, and cuts back to the foreground."""
    if radius < 1:
        return src.map(V(), LABEL)
    grown = extend_labeling_via_voronoi(opening_labels(src, radius))
    return binary.apply(src, grown, F.when(V() > 0, F.col("w")).otherwise(0.0), LABEL)


def smooth_connected_labels(src: Grid, radius: int = 0) -> Grid:
    return src.map(V(), LABEL) if radius < 1 else dilate_labels(erode_connected_labels(src, radius), radius)


def merge_touching_labels(src: Grid) -> Grid:
    """One label for all labels that touch, directly or through others."""
    from gridweave.operators.graph import touching_pairs

    edges = touching_pairs(src).filter("i > 0 AND j > 0").select(F.col("i").cast("double").alias("a"), F.col("j").cast("double").alias("b"))
    found = connected(edges).withColumnRenamed("node", "v")
    rows = src.df.join(found, "v", "left").select(*KEYS, F.coalesce("label", V()).alias("v"))
    return relabel_sequential(Grid(rows, src.shape, LABEL))


def combine_labels(src0: Grid, src1: Grid) -> Grid:
    """The second labels over the first, with ids that follow the first's."""
    top = src0.df.agg(F.max("v").alias("top"))
    second = Grid(src1.df.join(F.broadcast(top)), src1.shape, LABEL).map(F.when(V() != 0, V() + F.col("top")).otherwise(0.0))
    return relabel_sequential(binary.apply(src0.map(V(), LABEL), second, F.greatest(V(), F.col("w"))))


# -- filtering -----------------------------------------------------------------------


def keep_labels(src: Grid, keep: DataFrame) -> Grid:
    """Labels of the table (label) stay and are renumbered, the others become background."""
    ids = src.df.filter(V() != 0).select(V().alias("label")).distinct().join(keep.select(F.col("label").cast("double").alias("label")), "label", "left_semi")
    return paint(src, numbered(ids), "new", LABEL)


def remove_labels(src: Grid, flags: DataFrame) -> Grid:
    """Drops the labels that a table (label, v) flags with 1."""
    ids = src.df.filter(V() != 0).select(V().alias("label")).distinct()
    gone = flags.filter("v != 0").select(F.col("label").cast("double").alias("label"))
    return keep_labels(src, ids.join(gone, "label", "left_anti"))


def remove_labels_on_edges(src: Grid, exclude_x: bool = True, exclude_y: bool = True, exclude_z: bool = True) -> Grid:
    """Drops the labels that touch the chosen faces."""
    edge = F.lit(False)
    for axis, n, on in zip(AXES, src.shape, (exclude_x, exclude_y, exclude_z), strict=True):
        if on and n > 1:
            edge = edge | (F.col(axis) == 0) | (F.col(axis) == n - 1)
    gone = src.df.filter(edge).select(V().alias("label"), F.lit(1).alias("v")).distinct()
    return remove_labels(src, gone)


def remove_labels_with_map_values_out_of_range(src: Grid, values: DataFrame, min_value: float = 0, max_value: float = 100) -> Grid:
    return keep_labels(src, values.filter(F.col("v").between(min_value, max_value)))


def remove_labels_with_map_values_within_range(src: Grid, values: DataFrame, min_value: float = 0, max_value: float = 100) -> Grid:
    return keep_labels(src, values.filter(~F.col("v").between(min_value, max_value)))


def _sizes(src: Grid) -> DataFrame:
    return src.df.filter(V() != 0).groupBy(V().alias("label")).agg(F.count("*").cast("double").alias("v"))


def filter_label_by_size(src: Grid, minimum_size: float = 0, maximum_size: float = 100) -> Grid:
    return remove_labels_with_map_values_out_of_range(src, _sizes(src), minimum_size, maximum_size)


def remove_small_labels(src: Grid, minimum_size: float = 100) -> Grid:
    return filter_label_by_size(src, minimum_size, math.inf)


def exclude_small_labels(src: Grid, maximum_size: float = 100) -> Grid:
    return filter_label_by_size(src, maximum_size, math.inf)


def remove_large_labels(src: Grid, maximum_size: float = 100) -> Grid:
    return filter_label_by_size(src, 0, maximum_size)


def exclude_large_labels(src: Grid, minimum_size: float = 100) -> Grid:
    return filter_label_by_size(src, 0, minimum_size)


# -- statistics ------------------------------------------------------------------------


def labels_statistics(label: Grid | None, intensity: Grid | None = None, include_background: bool = False) -> DataFrame:
    """36 properties of each label; absent ids have area 0.  Without labels all is one label."""
    if label is None:
        label = intensity.map(F.lit(1.0), LABEL)
    rows = pair(label, intensity) if intensity else label.df.withColumn("w", V())
    rows = rows.select(*KEYS, V().cast("long").alias("label"), "w")
    if include_background:
        rows = rows.withColumn("label", F.col("label") + 1)
    rows = rows.filter("label > 0")
    aggs = [f(a).alias(f"bbox_{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
    aggs += [F.count("*").cast("double").alias("area"), F.min("w").alias("min_intensity"), F.max("w").alias("max_intensity"), F.sum("w").alias("sum_intensity"), F.avg("w").alias("mean_intensity"), F.stddev_pop("w").alias("standard_deviation_intensity")]
    aggs += [F.sum(F.col("w") * F.col(a)).alias(f"sum_intensity_times_{a}") for a in AXES] + [F.sum(a).cast("double").alias(f"sum_{a}") for a in AXES]
    one = rows.groupBy("label").agg(*aggs)
    for a in AXES:
        one = one.withColumns({
            f"bbox_{ {'x': 'width', 'y': 'height', 'z': 'depth'}[a]}": F.col(f"bbox_max_{a}") - F.col(f"bbox_min_{a}") + 1,
            f"mass_center_{a}": N.divide(F.col(f"sum_intensity_times_{a}"), F.col("sum_intensity")), f"centroid_{a}": F.col(f"sum_{a}") / F.col("area"),
        })
    mid = one.select("label", *(f"{m}_{a}" for m in ("centroid", "mass_center") for a in AXES))
    far = rows.join(mid, "label")
    dist = {m: F.sqrt(sum((F.pow(F.col(a) - F.col(f"{m}_{a}"), 2) for a in AXES), F.lit(0.0))) for m in ("centroid", "mass_center")}
    second = far.groupBy("label").agg(*(f(dist[m]).alias(f"{n}_distance_to_{m}") for m in dist for n, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max))))
    for m in dist:
        second = second.withColumn(f"mean_max_distance_to_{m}_ratio", N.divide(F.col(f"max_distance_to_{m}"), F.col(f"mean_distance_to_{m}")))
    both = one.join(second, "label")
    ids = ids_up_to(both.agg(F.max("label").alias("top")), 1)
    out = ids.join(both, "label", "left").na.fill(0.0)
    return out.withColumn("label", F.col("label") - 1) if include_background else out


def parametric_map(labels: Grid, properties: DataFrame, target_property: str) -> Grid:
    """A property of a statistics table at each label's voxels, background 0."""
    return paint(labels, properties.filter("label > 0"), target_property)


def _measured(labels: Grid, agg: Column, intensity: Grid | None = None) -> Grid:
    rows = pair(labels, intensity or labels).filter("v > 0")
    return paint(labels, rows.groupBy(V().alias("label")).agg(agg.alias("v")))


def mean_intensity_map(src: Grid, labels: Grid) -> Grid:
    return _measured(labels, F.avg("w"), src)


def minimum_intensity_map(src: Grid, labels: Grid) -> Grid:
    return _measured(labels, F.min("w"), src)


def maximum_intensity_map(src: Grid, labels: Grid) -> Grid:
    return _measured(labels, F.max("w"), src)


def standard_deviation_intensity_map(src: Grid, labels: Grid) -> Grid:
    return _measured(labels, F.stddev_pop("w"), src)


def pixel_count_map(src: Grid) -> Grid:
    return _measured(src, F.count("*").cast("double"))


def mean_extension_map(src: Grid) -> Grid:
    return parametric_map(src, labels_statistics(src), "mean_distance_to_centroid")


def maximum_extension_map(src: Grid) -> Grid:
    return parametric_map(src, labels_statistics(src), "max_distance_to_centroid")


def extension_ratio_map(src: Grid) -> Grid:
    return parametric_map(src, labels_statistics(src), "mean_max_distance_to_centroid_ratio")


def artificial_tissue(spark, width: int = 256, height: int = 256, depth: int = 1, delta_x: float = 10, delta_y: float = 10, delta_z: float = 0, sigma_x: float = 3, sigma_y: float = 3, sigma_z: float = 0, seed: int = 0) -> Grid:
    """A Voronoi tiling around a jittered hexagonal grid of seeds."""
    nx, ny = int(width / delta_x) + 1, int(height / delta_y) + 1
    nz = int(depth / delta_z) + 1 if delta_z > 0 else 1
    i = F.col("id")
    col, row, plane = i % nx, F.floor(i / nx) % ny, F.floor(i / (nx * ny))
    at = spark.range(nx * ny * nz).select(
        (col * delta_x + (row % 2) * delta_x / 2 + F.randn(seed) * sigma_x).alias("x"), (row * delta_y + F.randn(seed + 1) * sigma_y).alias("y"), (plane * delta_z + F.randn(seed + 2) * sigma_z).alias("z"),
    )
    inside = [F.floor(F.col(a)).cast("int").alias(a) for a in AXES]
    spots = at.select(*inside).filter((F.col("x").between(0, width - 1)) & (F.col("y").between(0, height - 1)) & (F.col("z").between(0, depth - 1))).distinct()
    grid = densify(spots.withColumn("v", F.lit(1.0)), (width, height, depth), 0.0, BINARY)
    return extend_labeling_via_voronoi(label_spots(Grid(cut(grid.df), grid.shape, BINARY)))
