"""The queries of the grid operators over the lake's tables, and their oracle SQL.

Three cubes are read from tables: E (embeddings: row = vector, column =
component), H (events: user class by day, counted) and Q (lineitem: part class,
supplier class, month, summed quantity).  L is a label image over H's shape, B
a binary one made of H.  The SQL builds the same cubes from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave import api as A
from gridweave.grid import FLOAT, Grid, positions
from gridweave.sources import from_array_column, from_counts

Query = Callable[[SparkSession, str], DataFrame]

HS, QS = (31, 64, 1), (64, 32, 12)


def grid_e(spark: SparkSession, sf: str) -> Grid:
    """64 components wide; as high as the largest id asks for."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    top = rows.agg(F.max("vec_id")).first()[0]  # from the file's statistics, or one narrow column
    return from_array_column(rows, F.col("vec_id"), "embedding", (64, 1 if top is None else int(top) + 1, 1))


def grid_h(spark: SparkSession, sf: str, dtype: str = FLOAT) -> Grid:
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts")
    return from_counts(rows, F.dayofmonth("ts") - 1, F.pmod("user_id", F.lit(64)), F.lit(0), HS, dtype=dtype)


def grid_q(spark: SparkSession, sf: str) -> Grid:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return from_counts(rows, F.pmod("l_partkey", F.lit(64)), F.pmod("l_suppkey", F.lit(32)), F.month("l_shipdate") - 1, QS, F.col("l_quantity"))


def grid_l(spark: SparkSession, sf: str) -> Grid:
    x, y = F.col("x"), F.col("y")
    label = F.when(y % 8 == 7, 0).otherwise(1 + F.floor(y / 4) * 8 + F.floor(x / 4))
    return Grid(positions(spark, HS).withColumn("v", label.cast("double")), HS, "UINT32")


def grid_b(spark: SparkSession, sf: str) -> Grid:
    return grid_h(spark, sf).map(F.col("v") % 2, "UINT8")


_E = "E AS (SELECT 0 AS z, CAST(vec_id AS INT) AS y, CAST(i - 1 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"
_H = """H AS (SELECT 0 AS z, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, CAST(coalesce(c.n, 0) AS DOUBLE) AS v FROM range(64) a(i) CROSS JOIN range(31) b(i)
LEFT JOIN (SELECT user_id % 64 AS y, day(ts) - 1 AS x, count(*) AS n FROM events GROUP BY ALL) c ON c.y = a.i AND c.x = b.i)"""
_Q = """Q AS (SELECT CAST(m.i AS INT) AS z, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, CAST(coalesce(c.n, 0) AS DOUBLE) AS v FROM range(12) m(i) CROSS JOIN range(32) a(i) CROSS JOIN range(64) b(i)
LEFT JOIN (SELECT month(l_shipdate) - 1 AS z, l_suppkey % 32 AS y, l_partkey % 64 AS x, sum(l_quantity) AS n FROM lineitem GROUP BY ALL) c ON c.z = m.i AND c.y = a.i AND c.x = b.i)"""
_L = "L AS (SELECT z, y, x, CAST(CASE WHEN y % 8 = 7 THEN 0 ELSE 1 + (y // 4) * 8 + x // 4 END AS DOUBLE) AS v FROM H)"
_B = "B AS (SELECT z, y, x, v % 2 AS v FROM H)"
_ALL = ",\n".join((_E, _H, _Q, _L, _B))

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _out(g: Grid | DataFrame | float | bool | list | tuple, spark: SparkSession) -> DataFrame:
    """A result as rows whose doubles are rounded, so that both engines agree."""
    if isinstance(g, (bool, int, float)):
        g = spark.createDataFrame([(float(g),)], "v double")
    elif isinstance(g, (list, tuple)):
        g = spark.createDataFrame([tuple(float(c) for c in g)], ", ".join(f"c{i} double" for i in range(len(g))))
    df = g.df.select("z", "y", "x", "v") if isinstance(g, Grid) else g
    named = [(F.col(f"`{c}`"), c, t) for c, t in df.dtypes]  # names may hold dots
    return df.select(*((F.round(c, 5) + 0.0).alias(n) if t in ("double", "float") else c.cast("long").alias(n) if t in ("int", "bigint") else c for c, n, t in named))


def add(name: str, fn: Callable[..., object], grids: str = "", sql: str | None = None) -> None:
    """Registers a query: ``fn`` of the named grids, and SQL that may use E, H, Q, L and B."""
    load = {"E": grid_e, "H": grid_h, "Q": grid_q, "L": grid_l, "B": grid_b}

    def query(spark: SparkSession, sf: str) -> DataFrame:
        args = [load[g](spark, sf) for g in grids]
        return _out(fn(*args) if grids else fn(spark), spark)

    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {_ALL}\n{sql}"


def vox(v: str, g: str = "H", where: str = "") -> str:
    """SQL of a point-wise result."""
    return f"SELECT CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round({v}, 5) + 0.0 AS v FROM {g} {where}"


# -- one grid, one voxel at a time --------------------------------------------------

_UNARY = {
    "absolute": "abs(v)", "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "asin": "asin(v)", "acos": "acos(v)", "atan": "atan(v)", "sinh": "sinh(v)",
    "cosh": "cosh(v)", "tanh": "tanh(v)", "cubic_root": "cbrt(v)", "exponential": "exp(v)", "exponential2": "pow(2.0, v)", "exponential10": "pow(10.0, v)",
    "sign": "sign(v)", "binary_not": "CASE WHEN v <> 0 THEN 0.0 ELSE 1.0 END", "undefined_to_zero": "v", "nan_to_num": "v", "invert": "-v", "square": "v * v",
    "degrees_to_radians": "radians(v)", "radians_to_degrees": "degrees(v)", "copy": "v",
}
for _n, _s in _UNARY.items():
    add(_n, A.OPERATORS[_n], "E", vox(_s, "E"))
for _n, _s in {"square_root": "sqrt(v)", "logarithm": "ln(v)", "logarithm2": "log2(v)", "logarithm10": "log10(v)", "reciprocal": "1 / v"}.items():
    add(_n, lambda g, f=A.OPERATORS[_n]: f(g.map(F.abs("v") + 0.1)), "E", vox(_s, "(SELECT z, y, x, abs(v) + 0.1 AS v FROM E)"))
for _n, _s in {"ceil": "ceil(v)", "floor": "floor(v)", "round": "round(v)", "truncate": "trunc(v)"}.items():
    add(_n, lambda g, f=A.OPERATORS[_n]: f(g.map(F.col("v") * 10)), "E", vox(_s, "(SELECT z, y, x, v * 10 AS v FROM E)"))

_SCALAR = {
    "add_image_and_scalar": (2.5, "v + 2.5"), "subtract_image_from_scalar": (2.5, "2.5 - v"), "multiply_image_and_scalar": (2.5, "v * 2.5"),
    "power": (2, "v * v"), "maximum_image_and_scalar": (0.1, "greatest(v, 0.1)"), "minimum_image_and_scalar": (0.1, "least(v, 0.1)"),
    "greater_constant": (0.1, "CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END"), "greater_or_equal_constant": (0.1, "CASE WHEN v >= 0.1 THEN 1.0 ELSE 0.0 END"),
    "smaller_constant": (0.1, "CASE WHEN v < 0.1 THEN 1.0 ELSE 0.0 END"), "smaller_or_equal_constant": (0.1, "CASE WHEN v <= 0.1 THEN 1.0 ELSE 0.0 END"),
}
for _n, (_a, _s) in _SCALAR.items():
    add(_n, lambda g, f=A.OPERATORS[_n], a=_a: f(g, a), "E", vox(_s, "E"))
add("divide_scalar_by_image", lambda g: A.divide_scalar_by_image(g.map(F.abs("v") + 0.1), 2.5), "E", vox("2.5 / (abs(v) + 0.1)", "E"))
add("equal_constant", lambda g: A.equal_constant(g, 3), "H", vox("CASE WHEN v = 3 THEN 1.0 ELSE 0.0 END"))
add("not_equal_constant", lambda g: A.not_equal_constant(g, 3), "H", vox("CASE WHEN v = 3 THEN 0.0 ELSE 1.0 END"))
add("clip", lambda g: A.clip(g, -0.1, 0.1), "E", vox("least(greatest(v, -0.1), 0.1)", "E"))
add("gamma_correction", lambda g: A.gamma_correction(g, 0.5), "H", vox("pow(v / m, 0.5) * m", "H, (SELECT max(v) AS m FROM H)"))
add("multiply_image_and_position", lambda g: A.multiply_image_and_position(g, 1), "Q", vox("v * y", "Q"))
add("evaluate", lambda g: A.evaluate("a > 0.1f ? a * s : fmax(-a, 0.05f)", [g, 3.0]), "E", vox("CASE WHEN v > 0.1 THEN v * 3 ELSE greatest(-v, 0.05) END", "E"))

for _n, _args, _s in [
    ("set", (7,), "7.0"), ("set_row", (3, 9), "CASE WHEN y = 3 THEN 9 ELSE v END"), ("set_column", (3, 9), "CASE WHEN x = 3 THEN 9 ELSE v END"), ("set_plane", (3, 9), "CASE WHEN z = 3 THEN 9 ELSE v END"),
    ("set_image_borders", (9,), "CASE WHEN x IN (0, 63) OR y IN (0, 31) OR z IN (0, 11) THEN 9 ELSE v END"),
    ("set_ramp_x", (), "CAST(x AS DOUBLE)"), ("set_ramp_y", (), "CAST(y AS DOUBLE)"), ("set_ramp_z", (), "CAST(z AS DOUBLE)"),
    ("set_where_x_equals_y", (9,), "CASE WHEN x = y THEN 9 ELSE v END"), ("set_where_x_greater_than_y", (9,), "CASE WHEN x > y THEN 9 ELSE v END"), ("set_where_x_smaller_than_y", (9,), "CASE WHEN x < y THEN 9 ELSE v END"),
    ("set_nonzero_pixels_to_pixelindex", (1,), "CASE WHEN v <> 0 THEN CAST(x + 64 * (y + 32 * z) + 1 AS DOUBLE) ELSE 0.0 END"), ("replace_value", (0, 5), "CASE WHEN v = 0 THEN 5.0 ELSE v END"),
]:
    add(_n, lambda g, f=A.OPERATORS[_n], a=_args: f(g, *a), "Q", vox(_s, "Q"))
add("artificial_tissue", lambda spark: A.artificial_tissue(spark, 64, 64))

# -- two grids ------------------------------------------------------------------------

_PAIR = {
    "add_images": "a.v + b.v", "subtract_images": "a.v - b.v", "multiply_images": "a.v * b.v", "maximum_images": "greatest(a.v, b.v)", "minimum_images": "least(a.v, b.v)",
    "absolute_difference": "abs(a.v - b.v)", "squared_difference": "(a.v - b.v) * (a.v - b.v)", "equal": "CASE WHEN a.v = b.v THEN 1.0 ELSE 0.0 END", "not_equal": "CASE WHEN a.v <> b.v THEN 1.0 ELSE 0.0 END",
    "greater": "CASE WHEN a.v > b.v THEN 1.0 ELSE 0.0 END", "greater_or_equal": "CASE WHEN a.v >= b.v THEN 1.0 ELSE 0.0 END", "smaller": "CASE WHEN a.v < b.v THEN 1.0 ELSE 0.0 END",
    "smaller_or_equal": "CASE WHEN a.v <= b.v THEN 1.0 ELSE 0.0 END", "binary_and": "CASE WHEN a.v <> 0 AND b.v <> 0 THEN 1.0 ELSE 0.0 END", "binary_or": "CASE WHEN a.v <> 0 OR b.v <> 0 THEN 1.0 ELSE 0.0 END",
    "binary_xor": "CASE WHEN (a.v <> 0) <> (b.v <> 0) THEN 1.0 ELSE 0.0 END", "binary_subtract": "CASE WHEN a.v <> 0 AND b.v = 0 THEN 1.0 ELSE 0.0 END", "mask": "CASE WHEN b.v <> 0 THEN a.v ELSE 0.0 END",
}


def two(v: str, a: str = "Q", b: str = "(SELECT z, y, 63 - x AS x, v FROM Q)", agg: bool = False) -> str:
    keys = "" if agg else "CAST(a.z AS BIGINT) AS z, CAST(a.y AS BIGINT) AS y, CAST(a.x AS BIGINT) AS x, "
    return f"SELECT {keys}round({v}, 5) + 0.0 AS v FROM {a} a JOIN {b} b ON a.z = b.z AND a.y = b.y AND a.x = b.x"


def _mirror(g: Grid) -> Grid:
    return A.flip(g, True, False, False)


for _n, _s in _PAIR.items():
    add(_n, lambda g, f=A.OPERATORS[_n]: f(g, _mirror(g)), "Q", two(_s))
add("divide_images", lambda g: A.divide_images(g, A.add_image_and_scalar(_mirror(g), 1)), "Q", two("a.v / (b.v + 1)"))
add("modulo_images", lambda g: A.modulo_images(g, A.add_image_and_scalar(_mirror(g), 1)), "Q", two("a.v % (b.v + 1)"))
add("power_images", lambda g: A.power_images(A.multiply_image_and_scalar(g, 0.01), A.multiply_image_and_scalar(_mirror(g), 0.01)), "Q", two("pow(a.v * 0.01, b.v * 0.01)"))
add("add_images_weighted", lambda g: A.add_images_weighted(g, _mirror(g), 2, -0.5), "Q", two("2 * a.v - 0.5 * b.v"))
add("mask_label", lambda h, lab: A.mask_label(h, lab, 5), "HL", two("CASE WHEN b.v = 5 THEN a.v ELSE 0.0 END", "H", "L"))

# -- coordinates -----------------------------------------------------------------------


def moved(z: str, y: str, x: str, g: str = "Q", where: str = "", v: str = "v") -> str:
    return f"SELECT CAST({z} AS BIGINT) AS z, CAST({y} AS BIGINT) AS y, CAST({x} AS BIGINT) AS x, round({v}, 5) + 0.0 AS v FROM {g} {where}"


add("crop", lambda g: A.crop(g, 5, 4, 3, 20, 10, 5), "Q", moved("z - 3", "y - 4", "x - 5", where="WHERE x BETWEEN 5 AND 24 AND y BETWEEN 4 AND 13 AND z BETWEEN 3 AND 7"))
add("crop_border", lambda g: A.crop_border(g, 2), "Q", moved("z - 2", "y - 2", "x - 2", where="WHERE x BETWEEN 2 AND 61 AND y BETWEEN 2 AND 29 AND z BETWEEN 2 AND 9"))
add("range", lambda g: A.range(g, 2, 62, 3, None, None, -2, 0, 12, 1), "Q", moved("z", "(31 - y) // 2", "(x - 2) // 3", where="WHERE x >= 2 AND x < 62 AND (x - 2) % 3 = 0 AND (31 - y) % 2 = 0"))
_P = "(SELECT a.z, a.y, a.x, coalesce(b.v, a.v) AS v FROM Q a LEFT JOIN (SELECT z + 2 AS z, y + 3 AS y, x + 4 AS x, v FROM Q) b ON a.z = b.z AND a.y = b.y AND a.x = b.x)"
add("paste", lambda g: A.paste(g, g, 4, 3, 2), "Q", moved("z", "y", "x", _P))
add("copy_slice", lambda g: A.copy_slice(g, None, 4), "Q", moved("0", "y", "x", where="WHERE z = 4"))
add("copy_horizontal_slice", lambda g: A.copy_horizontal_slice(g, None, 4), "Q", moved("0", "z", "x", where="WHERE y = 4"))
add("copy_vertical_slice", lambda g: A.copy_vertical_slice(g, None, 4), "Q", moved("0", "y", "z", where="WHERE x = 4"))
add("sub_stack", lambda g: A.sub_stack(g, 2, 5), "Q", moved("z - 2", "y", "x", where="WHERE z BETWEEN 2 AND 5"))
add("reduce_stack", lambda g: A.reduce_stack(g, 3, 1), "Q", moved("(z - 1) // 3", "y", "x", where="WHERE z >= 1 AND (z - 1) % 3 = 0 AND (z - 1) // 3 < 4"))
add("flip", lambda g: A.flip(g, True, True, False), "Q", moved("z", "31 - y", "63 - x"))
add("circular_shift", lambda g: A.circular_shift(g, 5, -3, 2), "Q", moved("(z + 2) % 12", "(y - 3 + 32) % 32", "(x + 5) % 64"))
add("transpose_xy", A.transpose_xy, "Q", moved("z", "x", "y"))
add("transpose_xz", A.transpose_xz, "Q", moved("x", "y", "z"))
add("transpose_yz", A.transpose_yz, "Q", moved("y", "z", "x"))
_PAD = "(SELECT 0 AS z, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, coalesce(c.v, 7) AS v FROM range(70) a(i) CROSS JOIN range(40) b(i) LEFT JOIN (SELECT y + 3 AS y, x + 5 AS x, v FROM H) c ON c.y = a.i AND c.x = b.i)"
add("pad", lambda g: A.pad(g, 40, 70, 1, 7, True), "H", moved("z", "y", "x", _PAD))
add("unpad", lambda g: A.unpad(g, 20, 50, 1, True), "H", moved("z", "y - 7", "x - 6", "H", "WHERE y >= 7 AND y < 57 AND x >= 6 AND x < 26"))
add("concatenate", lambda g: A.concatenate(g, g, 1), "H", moved("z", "y", "x", "(SELECT * FROM H UNION ALL SELECT z, y + 64, x, v FROM H)"))
add("concatenate_along_x", lambda g: A.concatenate_along_x(g, g), "H", moved("z", "y", "x", "(SELECT * FROM H UNION ALL SELECT z, y, x + 31, v FROM H)"))
add("concatenate_along_y", lambda g: A.concatenate_along_y(g, g), "H", moved("z", "y", "x", "(SELECT * FROM H UNION ALL SELECT z, y + 64, x, v FROM H)"))
add("concatenate_along_z", lambda g: A.concatenate_along_z(g, g), "H", moved("z", "y", "x", "(SELECT * FROM H UNION ALL SELECT z + 1, y, x, v FROM H)"))
add("reshape", lambda g: A.reshape(g, (64, 31, 1)), "H", moved("0", "(x + 31 * y) // 64", "(x + 31 * y) % 64", "H"))
_PTS = "SELECT i AS id, i * 2 AS x, i * 3 AS y, 0 AS z FROM range(15) p(i)"


def points(g: Grid) -> DataFrame:
    i = F.col("id")
    return g.spark.range(15).select("id", (i * 2).cast("double").alias("x"), (i * 3).cast("double").alias("y"), F.lit(0.0).alias("z"))


add("read_values_from_positions", lambda g: A.read_values_from_positions(g, points(g)), "H", f"SELECT p.id, round(H.v, 5) + 0.0 AS v FROM ({_PTS}) p JOIN H ON H.x = p.x AND H.y = p.y")
_SC = f"(SELECT H.z, H.y, H.x, coalesce(p.id + 1, 0) AS v FROM H LEFT JOIN ({_PTS}) p ON H.x = p.x AND H.y = p.y WHERE H.x < 29 AND H.y < 43)"
add("write_values_to_positions", lambda g: A.write_values_to_positions(points(g).withColumn("v", F.col("id") + 1.0)), "H", moved("z", "y", "x", _SC))

# -- aggregates and projections ---------------------------------------------------------


def scalar(v: str, g: str = "Q", where: str = "") -> str:
    return f"SELECT round({v}, 5) + 0.0 AS v FROM {g} {where}"


for _n, _s in {"maximum": "max(v)", "minimum": "min(v)", "sum": "sum(v)", "mean": "avg(v)", "standard_deviation": "stddev_pop(v)"}.items():
    add(f"{_n}_of_all_pixels", A.OPERATORS[f"{_n}_of_all_pixels"], "Q", scalar(_s))
add("mean_squared_error", lambda g: A.mean_squared_error(g, _mirror(g)), "Q", two("avg((a.v - b.v) * (a.v - b.v))", agg=True))
add("jaccard_index", lambda g: A.jaccard_index(g, _mirror(g)), "B", two("count(*) FILTER (WHERE a.v <> 0 AND b.v <> 0) / count(*) FILTER (WHERE a.v <> 0 OR b.v <> 0)", "B", "(SELECT z, y, 30 - x AS x, v FROM B)", True))
add("array_equal", lambda g: A.array_equal(g, _mirror(_mirror(g))), "H", "SELECT 1.0 AS v")
for _n, _s in {"maximum_position": "v DESC", "minimum_position": "v"}.items():
    add(_n, A.OPERATORS[_n], "Q", f"SELECT CAST(x AS DOUBLE) AS c0, CAST(y AS DOUBLE) AS c1, CAST(z AS DOUBLE) AS c2 FROM Q ORDER BY {_s}, z, y, x LIMIT 1")
add("minimum_of_masked_pixels", lambda h, b: A.minimum_of_masked_pixels(h, b), "HB", two("min(a.v)", "H", "(SELECT * FROM B WHERE v <> 0)", True))
add("minimum_of_masked_pixels_reduction", lambda q: A.minimum_of_masked_pixels_reduction(q, A.greater_constant(q, 20))[0], "Q", "SELECT CAST(0 AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, coalesce(min(v) FILTER (WHERE v > 20), 0.0) AS v FROM Q GROUP BY y, x")
_BOX = "SELECT {} FROM {} WHERE {}"
_ENDS = ", ".join(f"CAST({f}({c}) AS DOUBLE) AS c{i}" for i, (f, c) in enumerate(product(("min", "max"), "xyz")))
add("bounding_box", lambda g: A.bounding_box(A.greater_constant(g, 250)), "Q", _BOX.format(_ENDS.replace("AS DOUBLE", "AS DOUBLE"), "Q", "v > 250").replace("SELECT ", "SELECT coalesce(", 0))
add("label_bounding_box", lambda g: A.label_bounding_box(g, 12), "L", _BOX.format(_ENDS, "L", "v = 12"))
add("center_of_mass", A.center_of_mass, "Q", "SELECT " + ", ".join(f"round(sum(v * {c}) / sum(v), 5) + 0.0 AS c{i}" for i, c in enumerate("xyz")) + " FROM Q")

for _axis, (_a, _b) in {"x": ("z", "y"), "y": ("x", "z"), "z": ("x", "y")}.items():
    _g = f"SELECT CAST(0 AS BIGINT) AS z, CAST({_b} AS BIGINT) AS y, CAST({_a} AS BIGINT) AS x, round(%s, 5) + 0.0 AS v FROM Q GROUP BY {_a}, {_b}"
    for _k, _s in {"maximum": "max(v)", "minimum": "min(v)", "mean": "avg(v)", "sum": "sum(v)", "std": "coalesce(stddev_samp(v), 0.0)"}.items():
        add(f"{_k}_{_axis}_projection", A.OPERATORS[f"{_k}_{_axis}_projection"], "Q", _g % _s)
    for _k, _o in (("maximum", "v DESC"), ("minimum", "v")):
        _n = f"{_axis}_position_of_{_k}_{_axis}_projection"
        add(_n, A.OPERATORS[_n], "Q", _g % f"CAST(first({_axis} ORDER BY {_o}, {_axis}) AS DOUBLE)")
add("z_position_projection", lambda g: A.z_position_projection(g, A.z_position_of_maximum_z_projection(g)), "Q", "SELECT CAST(0 AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, max(v) + 0.0 AS v FROM Q GROUP BY y, x")
add("extended_depth_of_focus_variance_projection", lambda g: A.extended_depth_of_focus_variance_projection(g, 2, 2, 1), "Q")
add("extended_depth_of_focus_sobel_projection", lambda g: A.extended_depth_of_focus_sobel_projection(g, 1), "Q")
add("sum_reduction_x", lambda g: A.sum_reduction_x(g, 10), "Q", "SELECT CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x // 10 AS BIGINT) AS x, sum(v) + 0.0 AS v FROM Q WHERE x < 60 GROUP BY z, y, x // 10")
add("block_enumerate", lambda g: A.block_enumerate(g, None, 8), "B", moved("z", "y", "x", "(SELECT z, y, x, CASE WHEN v <> 0 THEN sum(v) OVER (PARTITION BY z, y ORDER BY x) ELSE 0 END AS v FROM B)"))

# -- neighbourhoods ----------------------------------------------------------------------

_SIZE = {"H": HS, "B": HS, "L": HS, "Q": QS}


def near(g: str, offsets: list[tuple], agg: str, where: str = "") -> str:
    """SQL of a stencil: offsets (dz, dy, dx[, w]) with the edge repeated; a is the voxel, b a neighbour."""
    w, h, d = _SIZE[g]
    rows = ", ".join(f"({o[0]}, {o[1]}, {o[2]}, {float(o[3]) if len(o) > 3 else 1.0!r}::DOUBLE)" for o in offsets)
    at = " AND ".join(f"b.{c} = least(greatest(a.{c} + o.d{c}, 0), {n - 1})" for c, n in (("z", d), ("y", h), ("x", w)))
    return f"SELECT CAST(a.z AS BIGINT) AS z, CAST(a.y AS BIGINT) AS y, CAST(a.x AS BIGINT) AS x, round({agg}, 5) + 0.0 AS v FROM {g} a CROSS JOIN (VALUES {rows}) o(dz, dy, dx, w) JOIN {g} b ON {at} {where} GROUP BY a.z, a.y, a.x, a.v"


_B1 = [(0, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
_S1 = [(0, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
_B2 = [(0, y, x) for y in range(-2, 3) for x in range(-2, 3)]
_MED = "list_sort(list(b.v))[len(list(b.v)) // 2 + 1]"
_MODE = "CAST(list_sort(list_filter(list(b.v), lambda q: len(list_filter(list(b.v), lambda r: r = q)) = list_max(list_transform(list(b.v), lambda s: len(list_filter(list(b.v), lambda r: r = s))))))[1] AS DOUBLE)"
for _n, _s in {"mean_filter": "avg(b.v)", "maximum_filter": "max(b.v)", "minimum_filter": "min(b.v)", "grayscale_dilate": "max(b.v)", "grayscale_erode": "min(b.v)", "variance_filter": "var_pop(b.v)", "standard_deviation": "stddev_pop(b.v)", "median": _MED}.items():
    add(_n, lambda g, f=A.OPERATORS[_n]: f(g, 2, 2, 2), "H", near("H", _B2, _s))
add("mode", lambda g: A.mode(g, 1, 1, 1), "H", f"SELECT z, y, x, v FROM (SELECT z, y, x, v, row_number() OVER (PARTITION BY z, y, x ORDER BY n DESC, v) AS r FROM (SELECT CAST(a.z AS BIGINT) AS z, CAST(a.y AS BIGINT) AS y, CAST(a.x AS BIGINT) AS x, b.v, count(*) AS n FROM H a CROSS JOIN (VALUES {', '.join(map(str, _B1))}) o(dz, dy, dx) JOIN H b ON b.y = least(greatest(a.y + o.dy, 0), 63) AND b.x = least(greatest(a.x + o.dx, 0), 30) GROUP BY ALL)) WHERE r = 1")
for _n, _s in {"mean_sphere": "avg(b.v)", "maximum_sphere": "max(b.v)", "minimum_sphere": "min(b.v)", "variance_sphere": "var_pop(b.v)", "median_sphere": _MED}.items():
    add(_n, A.OPERATORS[_n], "H", near("H", _S1, _s))


def taps(w: list[float], axis: str) -> list[tuple]:
    r = len(w) // 2
    return [((0, k - r, 0, v) if axis == "y" else (0, 0, k - r, v)) for k, v in enumerate(w)]


def separable(wx: list[float], wy: list[float], g: str = "H") -> str:
    """SQL of two weighted passes, as a subquery (z, y, x, v) of unrounded doubles."""
    out = [(0, a[1], b[2], a[3] * b[3]) for a in taps(wy, "y") for b in taps(wx, "x")]
    return near(g, out, "sum(o.w * b.v)")


def _gauss(s: float, order: int = 0, derivative: bool = False) -> list[float]:
    n = int(8 * s)
    r = (int(8 * s + 0.5) - 1) // 2 if derivative else (n + 1 - n % 2) // 2
    x = np.arange(-r, r + 1)
    g = np.exp(-(x**2) / (2 * s * s))
    if order == 1:
        g *= x / s**2
    return (g / (g.sum() if order == 0 else 1 + np.abs(g).sum())).tolist()


add("gaussian_blur", lambda g: A.gaussian_blur(g, 1, 1, 1), "H", separable(_gauss(1), _gauss(1)))
add("gaussian_derivative", lambda g: A.gaussian_derivative(g, 0.5, 0.5, 0, 1, 0, 0), "H", separable(_gauss(0.5, 1, True), _gauss(0.5, 0, True)))
_G1, _G2 = separable(_gauss(1), _gauss(1)).replace("round(sum(o.w * b.v), 5) + 0.0", "sum(o.w * b.v)"), separable(_gauss(0.5), _gauss(0.5)).replace("round(sum(o.w * b.v), 5) + 0.0", "sum(o.w * b.v)")
add("difference_of_gaussian", lambda g: A.difference_of_gaussian(g, 1, 1, 1, 0.5, 0.5, 0.5), "H", two("a.v - b.v", f"({_G1})", f"({_G2})"))
add("subtract_gaussian_background", lambda g: A.subtract_gaussian_background(g, 1, 1, 1), "H", two("a.v - b.v", "H", f"({_G1})"))
add("divide_by_gaussian_background", lambda g: A.divide_by_gaussian_background(g, 1, 1, 1), "H", two("a.v / b.v", "H", f"(SELECT * FROM ({_G1}))"))
_K = np.array([[1, 2, 1], [0, 1, 0], [-1, 0, 3]], float)
_KO = [(0, i - 1, j - 1, _K[i, j]) for i in range(3) for j in range(3)]
add("convolve", lambda g: A.convolve(g, _K), "H", near("H", _KO, "sum(o.w * b.v)"))
add("local_cross_correlation", lambda g: A.local_cross_correlation(g, _K), "H", near("H", _KO, "CASE WHEN sum(b.v * b.v) > 0 THEN sum(o.w * b.v) / sqrt(sum(b.v * b.v) * sum(o.w * o.w)) ELSE 0.0 END"))
add("laplace", A.laplace, "H", near("H", _B1, "9 * a.v - sum(b.v)"))
add("laplace_diamond", A.laplace_diamond, "H", near("H", _S1, "5 * a.v - sum(b.v)"))
_SX = [(0, y, x, x * (2 - abs(y))) for y in (-1, 0, 1) for x in (-1, 0, 1)]
add("sobel", A.sobel, "H", near("H", _SX, "sqrt(pow(sum(o.dx * (2 - abs(o.dy)) * b.v), 2) + pow(sum(o.dy * (2 - abs(o.dx)) * b.v), 2))"))
add("gradient_x", A.gradient_x, "Q", near("Q", [(0, 0, -1, -1), (0, 0, 1, 1)], "sum(o.w * b.v)"))
add("gradient_y", A.gradient_y, "Q", near("Q", [(0, -1, 0, -1), (0, 1, 0, 1)], "sum(o.w * b.v)"))
add("gradient_z", A.gradient_z, "Q", near("Q", [(-1, 0, 0, -1), (1, 0, 0, 1)], "sum(o.w * b.v)"))
_XX, _YY = "sum(CASE WHEN o.dy = 0 THEN b.v * (3 * abs(o.dx) - 2) ELSE 0 END)", "sum(CASE WHEN o.dx = 0 THEN b.v * (3 * abs(o.dy) - 2) ELSE 0 END)"
_XY = "sum(o.dx * o.dy * b.v) / 4"
for _n, _o in (("small_hessian_eigenvalue", "-"), ("large_hessian_eigenvalue", "+")):
    add(_n, A.OPERATORS[_n], "H", near("H", _B1, f"({_XX} + {_YY}) / 2 {_o} sqrt(pow(({_XX} - {_YY}) / 2, 2) + pow({_XY}, 2))"))
add("hessian_eigenvalues", lambda g: A.hessian_eigenvalues(g)[0], "H", SQL["small_hessian_eigenvalue"].split("\n", _ALL.count("\n") + 1)[-1])


def _hessian(sigma: float) -> str:
    """SQL of (z, y, x, mean, gap) of the Hessian's eigenvalues: a slope is a slope along one axis, smooth along the other."""
    s = sigma / 2**0.5
    slope, smooth = np.array(_gauss(s, 1, True)), np.array(_gauss(s, 0, True))
    taps = [np.convolve(a, b).tolist() for a, b in ((smooth, smooth), (slope, smooth), (slope, slope))]
    part = {n: separable(taps[n.count("x")], taps[n.count("y")]).replace("round(sum(o.w * b.v), 5) + 0.0", "sum(o.w * b.v)") for n in ("xx", "yy", "xy")}
    return (
        "SELECT p.z, p.y, p.x, (p.v + q.v) / 2 AS mean, sqrt(pow((p.v - q.v) / 2, 2) + r.v * r.v) AS gap "
        f"FROM ({part['xx']}) p JOIN ({part['yy']}) q USING (z, y, x) JOIN ({part['xy']}) r USING (z, y, x)"
    )


def _sato(*sigmas: float) -> str:
    parts = " UNION ALL ".join(f"SELECT z, y, x, greatest(gap - mean, 0) * {s * s} AS v FROM ({_hessian(s)})" for s in sigmas)
    return f"SELECT z, y, x, round(max(v), 5) + 0.0 AS v FROM ({parts}) GROUP BY z, y, x"


add("hessian_gaussian_eigenvalues", lambda g: A.hessian_gaussian_eigenvalues(g, 1)[0], "H", f"SELECT z, y, x, round(mean + gap, 5) + 0.0 AS v FROM ({_hessian(1)})")
add("sato_filter", lambda g: A.sato_filter(g, 1, 3, 1), "H", _sato(1, 2))
add("tubeness", lambda g: A.tubeness(g, 1), "H", _sato(1))


def chain(g: str, steps: list[tuple[list, str]], last: str = "c.v") -> str:
    """SQL of stencils one after the other."""
    sql = near(g, *steps[0])
    for offsets, agg in steps[1:]:
        sql = near("Z", offsets, agg).replace("FROM Z a", f"FROM ({sql}) a").replace("JOIN Z b", f"JOIN ({sql}) b")
    return sql


_SIZE["Z"] = HS
_MX, _MN = (_B1, "max(b.v)"), (_B1, "min(b.v)")
add("grayscale_opening", A.grayscale_opening, "H", chain("H", [_MN, _MX]))
add("grayscale_closing", A.grayscale_closing, "H", chain("H", [_MX, _MN]))
add("top_hat", A.top_hat, "H", two("a.v - b.v", "H", f"({chain('H', [_MN, _MX])})"))
add("bottom_hat", A.bottom_hat, "H", two("b.v - a.v", "H", f"({chain('H', [_MX, _MN])})"))
_INSIDE = "WHERE a.y + o.dy BETWEEN 0 AND 63 AND a.x + o.dx BETWEEN 0 AND 30"
_RING = [o for o in _B1 if o != (0, 0, 0)]
add("detect_maxima", A.detect_maxima, "H", near("H", _RING, "CASE WHEN a.v > max(b.v) THEN 1.0 ELSE 0.0 END", _INSIDE))
add("detect_minima", A.detect_minima, "H", near("H", _RING, "CASE WHEN a.v < min(b.v) THEN 1.0 ELSE 0.0 END", _INSIDE))
add("clahe", lambda g: A.clahe(g, 8), "H")
add("morphological_chan_vese", lambda g: A.morphological_chan_vese(g, 3), "H")

# -- morphology ---------------------------------------------------------------------------

_PLUS = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]])
add("dilation", lambda g: A.dilation(g, _PLUS), "H", near("H", _S1, "max(b.v)"))
add("erosion", lambda g: A.erosion(g, _PLUS), "H", near("H", _S1, "min(b.v)"))
add("opening", lambda g: A.opening(g, _PLUS), "H", chain("H", [(_S1, "min(b.v)"), (_S1, "max(b.v)")]))
add("closing", lambda g: A.closing(g, _PLUS), "H", chain("H", [(_S1, "max(b.v)"), (_S1, "min(b.v)")]))
add("binary_dilate", A.binary_dilate, "B", near("B", _B1, "max(b.v)"))
add("binary_erode", A.binary_erode, "B", near("B", _B1, "min(b.v)"))
add("binary_opening", A.binary_opening, "B", chain("B", [_MN, _MX]))
add("binary_closing", A.binary_closing, "B", chain("B", [_MX, _MN]))
_LN = [[(0, -a, -b), (0, 0, 0), (0, a, b)] for a, b in ((0, 1), (1, 0), (1, 1), (1, -1))]
_AT = "CASE WHEN a.y + o.dy BETWEEN 0 AND 63 AND a.x + o.dx BETWEEN 0 AND 30 THEN b.v ELSE 0 END"  # 0 outside
_PART = {k: ", ".join(f"{f}({_AT}) FILTER (WHERE (o.dy, o.dx) IN ({', '.join(str(o[1:]) for o in g)}))" for g in _LN) for k, f in (("lo", "min"), ("hi", "max"))}
add("binary_supinf", A.binary_supinf, "B", near("B", _B1, f"greatest({_PART['lo']})"))
add("binary_infsup", A.binary_infsup, "B", near("B", _B1, f"least({_PART['hi']})"))
add("binary_edge_detection", A.binary_edge_detection, "B", near("B", _B1, "CASE WHEN a.v <> 0 AND min(b.v) = 0 THEN 1.0 ELSE 0.0 END"))
add("nonzero_maximum", A.nonzero_maximum, "H", near("H", _B1, "CASE WHEN a.v <> 0 THEN max(b.v) ELSE 0.0 END"))
add("nonzero_minimum", A.nonzero_minimum, "H", near("H", _B1, "CASE WHEN a.v <> 0 THEN min(b.v) FILTER (WHERE b.v <> 0) ELSE 0.0 END"))
add("onlyzero_overwrite_maximum", A.onlyzero_overwrite_maximum, "H", near("H", _B1, "CASE WHEN a.v = 0 THEN max(b.v) ELSE a.v END"))

# -- histograms and thresholds --------------------------------------------------------------

_HB = """, hm AS (SELECT min(v) AS lo, max(v) AS hi FROM H), hb AS (SELECT CAST(floor((v - lo) / (hi - lo) * 255 + 0.5) AS INT) AS bin, lo, hi FROM H, hm),
c AS (SELECT CAST(i AS INT) AS bin, lo + i * (hi - lo) / 255.0 AS c, lo, hi, coalesce(n, 0) AS n FROM range(256) r(i) CROSS JOIN hm LEFT JOIN (SELECT bin, count(*) AS n FROM hb GROUP BY bin) t ON t.bin = i)"""


def with_bins(sql: str) -> str:
    return _HB + "\n" + sql


def add_bins(name: str, fn, sql: str) -> None:
    add(name, fn, "H", None)
    SQL[name] = f"WITH {_ALL}{with_bins(sql)}"


add_bins("histogram", A.histogram, "SELECT CAST(bin AS BIGINT) AS bin, CAST(n AS BIGINT) AS n FROM c")
_OTSU = """, s AS (SELECT bin, c, sum(n) OVER u AS w1, sum(n) OVER d AS w2, sum(n * c) OVER u AS s1, sum(n * c) OVER d AS s2 FROM c
WINDOW u AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), d AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t AS (SELECT c AS threshold FROM s WHERE w1 > 0 AND w2 > 0 ORDER BY round(w1 * w2 * pow(s1 / w1 - s2 / w2, 2), 6) DESC, bin LIMIT 1)\n"""
_ABOVE = vox("CASE WHEN v > threshold THEN 1.0 ELSE 0.0 END", "H, t")
add_bins("threshold_otsu", A.threshold_otsu, _OTSU + _ABOVE)
_YEN = """, p AS (SELECT bin, c, n / sum(n) OVER () AS p FROM c), s AS (SELECT bin, c, sum(p) OVER u AS p1, sum(p * p) OVER u AS a, sum(p * p) OVER d AS b FROM p
WINDOW u AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), d AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t AS (SELECT c AS threshold FROM s WHERE a * b > 0 AND p1 * (1 - p1) > 0 ORDER BY round(ln(pow(p1 * (1 - p1), 2) / (a * b)), 9) DESC, bin LIMIT 1)\n"""
add_bins("threshold_yen", A.threshold_yen, _YEN + _ABOVE)
add("threshold_mean", A.threshold_mean, "H", vox("CASE WHEN v > m THEN 1.0 ELSE 0.0 END", "H, (SELECT avg(v) AS m FROM H)"))


def _pct(p: float) -> str:
    return f"""(SELECT CASE WHEN bin = 0 THEN lo ELSE lo + (bin - 1 + (target - before) / (cum - before)) * (hi - lo) / 255.0 END FROM
(SELECT bin, lo, hi, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER (ORDER BY bin) - n AS before, sum(n) OVER () * {p / 100} AS target FROM c) WHERE cum >= target ORDER BY bin LIMIT 1)"""


add_bins("percentile", lambda g: A.percentile(g, 70), f"SELECT round({_pct(70)}, 5) + 0.0 AS v")
add_bins("normalize", lambda g: A.normalize(g, 10, 90), vox(f"greatest(0.0, least(1.0, (v - round({_pct(10)})) / (round({_pct(90)}) - round({_pct(10)}))))"))

# -- labels -----------------------------------------------------------------------------------


def painted(table: str, missing: str = "0.0") -> str:
    """SQL of a label table (label, v) painted on L."""
    return f"SELECT CAST(L.z AS BIGINT) AS z, CAST(L.y AS BIGINT) AS y, CAST(L.x AS BIGINT) AS x, round(coalesce(t.v, {missing}), 5) + 0.0 AS v FROM L LEFT JOIN ({table}) t ON t.label = L.v"


def _table(g: Grid) -> DataFrame:
    return g.df.select(F.col("v").cast("long").alias("label")).distinct().withColumn("v", (F.col("label") % 7).cast("double"))


_TAB = "SELECT DISTINCT CAST(v AS BIGINT) AS label, v % 7 AS v FROM L"
_LH = "(SELECT L.z, L.y, L.x, CAST(L.v AS BIGINT) AS label, H.v FROM L JOIN H USING (z, y, x) WHERE L.v > 0)"
_RANK = "SELECT label, CAST(dense_rank() OVER (ORDER BY label) AS DOUBLE) AS v FROM (SELECT DISTINCT CAST(v AS BIGINT) AS label FROM L WHERE v > 0) WHERE {}"


def _gaps(g: Grid) -> Grid:
    return g.map(F.when(F.col("v") % 3 == 0, 0).otherwise(F.col("v")))


add("replace_values", lambda g: A.replace_values(g, _table(g)), "L", painted(_TAB))
add("relabel_sequential", lambda g: A.relabel_sequential(_gaps(g)), "L", painted(_RANK.format("label % 3 <> 0")))
add("flag_existing_labels", lambda g: A.flag_existing_labels(_gaps(g)), "L", "SELECT i AS label, CASE WHEN EXISTS (SELECT 1 FROM L WHERE v = i) AND i % 3 <> 0 OR i = 0 THEN 1.0 ELSE 0.0 END AS v FROM range(0, (SELECT CAST(max(v) FILTER (WHERE v % 3 <> 0) AS BIGINT) + 1 FROM L)) r(i)")
add("read_map_values", lambda h, g: A.read_map_values(h, g), "HL", "SELECT CAST(L.v AS BIGINT) AS label, max(H.v) AS v FROM L JOIN H USING (z, y, x) GROUP BY L.v")
_SPOT = "(SELECT z, y, x, CASE WHEN v <> 0 THEN CAST(row_number() OVER (PARTITION BY v <> 0 ORDER BY z, y, x) AS DOUBLE) ELSE 0.0 END AS v FROM B)"
add("label_spots", A.label_spots, "B", moved("z", "y", "x", _SPOT))
add("spots_to_pointlist", A.spots_to_pointlist, "B", f"SELECT CAST(v AS BIGINT) - 1 AS id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z FROM {_SPOT} WHERE v > 0")
add("labelled_spots_to_pointlist", lambda g: A.labelled_spots_to_pointlist(A.label_spots(g)), "B", SQL["spots_to_pointlist"].removeprefix(f"WITH {_ALL}\n"))
add("pointlist_to_labelled_spots", lambda g: A.pointlist_to_labelled_spots(points(g), HS), "H", moved("z", "y", "x", f"(SELECT H.z, H.y, H.x, coalesce(p.id + 1, 0) AS v FROM H LEFT JOIN ({_PTS}) p ON H.x = p.x AND H.y = p.y)"))
_EDGE = near("L", _S1, "CASE WHEN max(b.v) <> a.v OR min(b.v) <> a.v THEN 1.0 ELSE 0.0 END")
add("detect_label_edges", A.detect_label_edges, "L", _EDGE)
add("reduce_labels_to_label_edges", A.reduce_labels_to_label_edges, "L", near("L", _S1, "CASE WHEN max(b.v) <> a.v OR min(b.v) <> a.v THEN a.v ELSE 0.0 END"))
add("centroids_of_labels", A.centroids_of_labels, "L", "SELECT CAST(v AS BIGINT) AS label, round(avg(x), 5) + 0.0 AS x, round(avg(y), 5) + 0.0 AS y, round(avg(z), 5) + 0.0 AS z FROM L WHERE v > 0 GROUP BY v")
add("reduce_labels_to_centroids", A.reduce_labels_to_centroids, "L", moved("z", "y", "x", "(SELECT L.z, L.y, L.x, CASE WHEN c.v IS NULL THEN 0.0 ELSE c.v END AS v FROM L LEFT JOIN (SELECT v, floor(avg(x)) AS x, floor(avg(y)) AS y FROM L WHERE v > 0 GROUP BY v) c ON L.x = c.x AND L.y = c.y)"))
for _n in ("connected_component_labeling", "voronoi_labeling"):
    add(_n, A.OPERATORS[_n], "B")
add("extend_labeling_via_voronoi", A.extend_labeling_via_voronoi, "L", near("L", _B1, "CASE WHEN a.v = 0 THEN max(b.v) ELSE a.v END"))
add("dilate_labels", lambda g: A.dilate_labels(g, 1), "L", near("L", _B1, "CASE WHEN a.v = 0 THEN max(b.v) ELSE a.v END"))
_CORE = near("L", _S1, "CASE WHEN max(b.v) <> a.v OR min(b.v) <> a.v THEN 0.0 ELSE a.v END")
_ERODED = f"SELECT e.z, e.y, e.x, CASE WHEN e.v = 0 THEN 0.0 ELSE CAST(r.n AS DOUBLE) END AS v FROM ({_CORE}) e LEFT JOIN (SELECT v, dense_rank() OVER (ORDER BY v) AS n FROM (SELECT DISTINCT v FROM ({_CORE}) WHERE v > 0)) r ON r.v = e.v"
add("erode_labels", lambda g: A.erode_labels(g, 1), "L", _ERODED)
add("opening_labels", lambda g: A.opening_labels(g, 1), "L", near("Z", _B1, "CASE WHEN a.v = 0 THEN max(b.v) ELSE a.v END").replace("FROM Z a", f"FROM ({_ERODED}) a").replace("JOIN Z b", f"JOIN ({_ERODED}) b"))
for _n, _f in {
    "masked_voronoi_labeling": lambda b, h: A.masked_voronoi_labeling(b, A.greater_constant(h, 0)), "gauss_otsu_labeling": lambda b, h: A.gauss_otsu_labeling(h, 1),
    "voronoi_otsu_labeling": lambda b, h: A.voronoi_otsu_labeling(h, 1, 1), "eroded_otsu_labeling": lambda b, h: A.eroded_otsu_labeling(h, 1, 1),
}.items():
    add(_n, _f, "BH")
for _n in ("closing_labels", "erode_connected_labels", "smooth_labels", "smooth_connected_labels"):
    add(_n, lambda g, f=A.OPERATORS[_n]: f(_gaps(g), 1), "L")
add("merge_touching_labels", lambda g: A.merge_touching_labels(g), "L", painted("SELECT DISTINCT CAST(v AS BIGINT) AS label, y // 8 + 1.0 AS v FROM L WHERE v > 0"))
add("combine_labels", lambda g: A.combine_labels(g, A.circular_shift(g, 0, 0, 0)), "L", painted("SELECT label, CAST(dense_rank() OVER (ORDER BY label) AS DOUBLE) AS v FROM (SELECT DISTINCT CAST(v AS BIGINT) AS label FROM L WHERE v > 0)"))

for _n, _f, _w in [
    ("remove_labels", lambda g: A.remove_labels(g, g.df.select(F.col("v").alias("label")).distinct().withColumn("v", (F.col("label") % 5 == 0).cast("int"))), "label % 5 <> 0"),
    ("remove_labels_on_edges", A.remove_labels_on_edges, "label NOT IN (SELECT v FROM L WHERE x IN (0, 30) OR y IN (0, 63))"),
    ("remove_labels_with_map_values_out_of_range", lambda g: A.remove_labels_with_map_values_out_of_range(g, _table(g), 2, 4), "label % 7 BETWEEN 2 AND 4"),
    ("remove_labels_with_map_values_within_range", lambda g: A.remove_labels_with_map_values_within_range(g, _table(g), 2, 4), "label % 7 NOT BETWEEN 2 AND 4"),
    ("filter_label_by_size", lambda g: A.filter_label_by_size(g, 10, 15), "label IN (SELECT v FROM L GROUP BY v HAVING count(*) BETWEEN 10 AND 15)"),
    ("remove_small_labels", lambda g: A.remove_small_labels(g, 13), "label IN (SELECT v FROM L GROUP BY v HAVING count(*) >= 13)"),
    ("exclude_small_labels", lambda g: A.exclude_small_labels(g, 13), "label IN (SELECT v FROM L GROUP BY v HAVING count(*) >= 13)"),
    ("remove_large_labels", lambda g: A.remove_large_labels(g, 13), "label IN (SELECT v FROM L GROUP BY v HAVING count(*) <= 13)"),
    ("exclude_large_labels", lambda g: A.exclude_large_labels(g, 13), "label IN (SELECT v FROM L GROUP BY v HAVING count(*) <= 13)"),
]:
    add(_n, _f, "L", painted(_RANK.format(_w)))
for _alias, _n in {"exclude_labels": "remove_labels", "exclude_labels_on_edges": "remove_labels_on_edges", "exclude_labels_outside_size_range": "filter_label_by_size"}.items():
    QUERIES[_alias], SQL[_alias] = QUERIES[_n], SQL[_n]

_CEN = "(SELECT CAST(v AS BIGINT) AS label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM L WHERE v > 0 GROUP BY v)"
_DIST = f"(SELECT s.label, s.v, sqrt(pow(s.x - c.cx, 2) + pow(s.y - c.cy, 2) + pow(s.z - c.cz, 2)) AS d FROM {_LH} s JOIN {_CEN} c USING (label))"
add("labels_statistics", lambda h, g: A.labels_statistics(g, h).select("label", "area", "min_intensity", "max_intensity", "sum_intensity", "mean_intensity", "standard_deviation_intensity", "bbox_width", "bbox_height", "centroid_x", "centroid_y", "mean_distance_to_centroid", "max_distance_to_centroid"), "HL", f"""
SELECT a.*, m.mean_distance_to_centroid, m.max_distance_to_centroid FROM (SELECT label, CAST(count(*) AS DOUBLE) AS area, min(v) AS min_intensity, max(v) AS max_intensity, sum(v) AS sum_intensity, round(avg(v), 5) + 0.0 AS mean_intensity, round(stddev_pop(v), 5) + 0.0 AS standard_deviation_intensity,
CAST(max(x) - min(x) + 1 AS BIGINT) AS bbox_width, CAST(max(y) - min(y) + 1 AS BIGINT) AS bbox_height, round(avg(x), 5) + 0.0 AS centroid_x, round(avg(y), 5) + 0.0 AS centroid_y FROM {_LH} GROUP BY label) a
JOIN (SELECT label, round(avg(d), 5) + 0.0 AS mean_distance_to_centroid, round(max(d), 5) + 0.0 AS max_distance_to_centroid FROM {_DIST} GROUP BY label) m USING (label)""")
add("parametric_map", lambda h, g: A.parametric_map(g, A.labels_statistics(g, h), "sum_intensity"), "HL", painted(f"SELECT label, sum(v) AS v FROM {_LH} GROUP BY label"))
for _n, _s in {"mean_intensity_map": "avg(v)", "minimum_intensity_map": "min(v)", "maximum_intensity_map": "max(v)", "standard_deviation_intensity_map": "stddev_pop(v)"}.items():
    add(_n, lambda h, g, f=A.OPERATORS[_n]: f(h, g), "HL", painted(f"SELECT label, {_s} AS v FROM {_LH} GROUP BY label"))
add("pixel_count_map", A.pixel_count_map, "L", painted(f"SELECT label, CAST(count(*) AS DOUBLE) AS v FROM {_LH} GROUP BY label"))
for _n, _s in {"mean_extension_map": "avg(d)", "maximum_extension_map": "max(d)", "extension_ratio_map": "max(d) / avg(d)"}.items():
    add(_n, A.OPERATORS[_n], "L", painted(f"SELECT label, {_s} AS v FROM {_DIST} GROUP BY label"))

# -- graphs -------------------------------------------------------------------------------------

_FACE = "(SELECT CAST(a.v AS BIGINT) AS i, CAST(b.v AS BIGINT) AS j FROM L a JOIN L b ON (abs(a.x - b.x) + abs(a.y - b.y) = 1) AND a.x - b.x BETWEEN -1 AND 1 AND a.y - b.y BETWEEN -1 AND 1 WHERE a.v <> b.v)"
_FACE = "(SELECT CAST(a.v AS BIGINT) AS i, CAST(b.v AS BIGINT) AS j FROM L a CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) JOIN L b ON b.x = a.x + o.dx AND b.y = a.y + o.dy WHERE a.v <> b.v)"
_AREA = f"(SELECT i, j, CAST(count(*) AS DOUBLE) AS v FROM {_FACE} GROUP BY i, j)"
_TOUCH = f"(SELECT DISTINCT i, j FROM {_FACE})"
_IN = f"(SELECT * FROM {_TOUCH} WHERE i > 0 AND j > 0)"
_CDIST = f"(SELECT a.label AS i, b.label AS j, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2) + pow(a.cz - b.cz, 2)) AS d FROM {_CEN} a, {_CEN} b)"


def edges(v: str, table: str, where: str = "") -> str:
    return f"SELECT i, j, round({v}, 5) + 0.0 AS v FROM {table} {where}"


def by_label(v: str, table: str) -> str:
    return f"SELECT i AS label, round({v}, 5) + 0.0 AS v FROM {table} GROUP BY i"


add("generate_touch_matrix", A.generate_touch_matrix, "L", edges("1.0", _TOUCH))
add("generate_touching_area_matrix", A.generate_touching_area_matrix, "L", edges("v", _AREA))
add("generate_binary_overlap_matrix", lambda g: A.generate_binary_overlap_matrix(g, A.flip(g, False, True, False)), "L", "SELECT DISTINCT CAST(a.v AS BIGINT) AS i, CAST(b.v AS BIGINT) AS j, 1.0 AS v FROM L a JOIN L b ON a.x = b.x AND a.y = 63 - b.y")
_PORT = f"(SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS p FROM {_AREA})"
add("generate_partial_touching_area_matrix", A.generate_partial_touching_area_matrix, "L", edges("p", _PORT))
add("generate_partial_touching_area_matrix_within_range", lambda g: A.generate_partial_touching_area_matrix_within_range(A.generate_partial_touching_area_matrix(g), 0.2, 0.4), "L", edges("1.0", _PORT, "WHERE p > 0.2 AND p < 0.4"))
add("generate_distance_matrix", lambda g: A.centroid_distances(g), "L", edges("d", _CDIST))
add("generate_proximal_neighbors_matrix", lambda g: A.generate_proximal_neighbors_matrix(A.centroid_distances(g), 3, 9), "L", edges("1.0", _CDIST, "WHERE i <> j AND d BETWEEN 3 AND 9"))
add("count_touching_neighbors", lambda g: A.count_touching_neighbors(A.generate_touch_matrix(g)), "L", by_label("count(*)", _IN))
add("touching_neighbor_count_map", A.touching_neighbor_count_map, "L", painted(by_label("count(*)", _IN)))
for _n, _s in {"symmetric_maximum_matrix": "greatest(a, b)", "symmetric_minimum_matrix": "least(a, b)", "symmetric_mean_matrix": "(a + b) / 2"}.items():
    add(_n, lambda g, f=A.OPERATORS[_n]: f(A.generate_partial_touching_area_matrix(g)), "L", f"SELECT i, j, round({_s}, 5) + 0.0 AS v FROM (SELECT p.i, p.j, p.p AS a, q.p AS b FROM {_PORT} p JOIN {_PORT} q ON p.i = q.j AND p.j = q.i)")
add("standard_deviation_partial_touching_area_matrix", A.standard_deviation_partial_touching_area_matrix, "L", f"SELECT i AS label, round(CASE WHEN i = 0 THEN 0.0 ELSE sum(abs(p - 1.0 / k) / k) END, 5) + 0.0 AS v FROM (SELECT i, p, count(*) OVER (PARTITION BY i) AS k FROM {_PORT}) GROUP BY i")
_SELF = f"(SELECT n.i, t.v, t.label AS j FROM (SELECT * FROM {_IN} UNION SELECT CAST(v AS BIGINT), CAST(v AS BIGINT) FROM L WHERE v > 0) n JOIN ({_TAB}) t ON t.label = n.j)"
_OTHER = f"(SELECT n.i, t.v FROM {_IN} n JOIN ({_TAB}) t ON t.label = n.j)"
for _k, _s, _t in [
    ("mean", "avg(v)", _SELF), ("median", "list_sort(list(v))[count(*) // 2 + 1]", _SELF), ("minimum", "min(v)", _SELF), ("maximum", "max(v)", _SELF),
    ("standard_deviation", "sqrt(var_pop(v) * count(*) / (SELECT max(v) + 1 FROM L))", _SELF),
]:
    _n = f"{_k}_of_touching_neighbors"
    add(_n, lambda g, f=A.OPERATORS[_n]: f(_table(g), A.generate_touch_matrix(g)), "L", by_label(_s, _t))
    add(f"{_n}_map", lambda g, f=A.OPERATORS[f"{_n}_map"]: f(g.map(F.col("v") % 7), g), "L", painted(by_label(_s, _t)))
_MO = f"SELECT label, v FROM (SELECT i AS label, v, row_number() OVER (PARTITION BY i ORDER BY count(*) DESC, v) AS r FROM {_OTHER} GROUP BY i, v) WHERE r = 1"
add("mode_of_touching_neighbors", lambda g: A.mode_of_touching_neighbors(_table(g), A.generate_touch_matrix(g)), "L", _MO)
add("mode_of_touching_neighbors_map", lambda g: A.mode_of_touching_neighbors_map(g.map(F.col("v") % 7), g), "L", painted(_MO))
for _k, _s in {"minimum": "min(d)", "maximum": "max(d)", "mean": "avg(d)"}.items():
    _n = f"{_k}_distance_touching_neighbors"
    add(_n, lambda g, f=A.OPERATORS[_n]: f(A.centroid_distances(g), A.generate_touch_matrix(g)), "L", by_label(_s, f"(SELECT n.i, c.d FROM {_IN} n JOIN {_CDIST} c USING (i, j))"))
for _n, _s, _o in (("mean_distance_n_nearest_neighbors", "avg(d)", "d"), ("maximum_distance_n_nearest_neighbors", "max(d)", "d"), ("mean_distance_n_farthest_neighbors", "avg(d)", "d DESC")):
    add(_n, lambda g, f=A.OPERATORS[_n]: f(A.centroid_distances(g), 3), "L", by_label(_s, f"(SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY {_o}) AS r FROM {_CDIST} WHERE i <> j) WHERE r <= 3"))
_NEAR = f"SELECT c.label, CAST(count(d.d) AS DOUBLE) AS v FROM {_CEN} c LEFT JOIN (SELECT * FROM {_CDIST} WHERE i <> j AND d <= 9) d ON d.i = c.label GROUP BY c.label"
add("proximal_neighbor_count", lambda g: A.proximal_neighbor_count(g, -1, 9), "L", _NEAR)
add("proximal_neighbor_count_map", lambda g: A.proximal_neighbor_count_map(g, -1, 9), "L", painted(_NEAR))
add("multiply_matrix", lambda g: A.multiply_matrix(A.generate_touching_area_matrix(g), A.generate_touching_area_matrix(g)), "L", f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {_AREA} a JOIN {_AREA} b ON a.j = b.i GROUP BY a.i, b.j")
add("labels_neighbors_statistics", lambda g: A.labels_neighbors_statistics(g, (10,), (2,), (1,)), "L")

# -- transforms and spectra -----------------------------------------------------------------------

add("affine_transform", lambda g: A.affine_transform(g, [1, 0, 3, 0, 1, -2, 0, 0, 1]), "H", vox("coalesce(s.v, 0)", "(SELECT H.z, H.y, H.x, coalesce(b.v, 0) AS v FROM H LEFT JOIN H b ON b.x = H.x - 3 AND b.y = H.y + 2) s").replace("SELECT CAST(z", "SELECT CAST(s.z").replace("CAST(y", "CAST(s.y").replace("CAST(x", "CAST(s.x"))
add("translate", lambda g: A.translate(g, 3, -2, 0), "H", SQL["affine_transform"].removeprefix(f"WITH {_ALL}\n"))
add("scale", lambda g: A.scale(g, 1, 2, 1), "H", moved("z", "y", "x", "(SELECT H.z, H.y, H.x, b.v FROM H JOIN H b ON b.x = H.x AND b.y = CAST(floor((H.y + 0.5 - 32) / 2 + 32) AS INT))"))
add("rotate", lambda g: A.rotate(g, 0, 0, 90), "H", vox("v", "(SELECT H.z, H.y, H.x, coalesce(b.v, 0) AS v FROM H LEFT JOIN H b ON b.x = H.y - 16 AND b.y = 47 - H.x)"))
add("rigid_transform", lambda g: A.rigid_transform(g, 0, 0, 0, 0, 0, 180), "H", moved("z", "63 - y", "30 - x", "H"))
add("deskew_x", A.deskew_x, "Q")
add("deskew_y", A.deskew_y, "Q")
add("make_isotropic", lambda g: A.make_isotropic(g, 1, 2, 1, -1, False), "H", moved("a.z", "2 * a.y + k.i", "a.x", "H a CROSS JOIN range(2) k(i)", v="a.v"))
add("make_anisotropic", lambda g: A.make_anisotropic(g, 2, 2, 1, 2, False), "H", moved("a.z", "2 * a.y + k.i", "a.x", "H a CROSS JOIN range(2) k(i)", v="a.v"))
add("fft", A.fft, "H")
add("ifft", lambda g: A.ifft(A.fft(g), HS), "H", vox("v"))
add("convolve_fft", lambda g: A.convolve_fft(g, _K), "H", 
    "SELECT CAST(a.z AS BIGINT) AS z, CAST(a.y AS BIGINT) AS y, CAST(a.x AS BIGINT) AS x, round(sum(o.w * coalesce(b.v, 0)), 5) + 0.0 AS v "
    f"FROM H a CROSS JOIN (VALUES {', '.join(f'({i}, {j}, {float(w)!r}::DOUBLE)' for (i, j), w in np.ndenumerate(_K))}) o(i, j, w) "
    # 64 rows and 31 columns behind one of zeros, both round
    "LEFT JOIN H b ON b.y = (a.y - o.i + 64) % 64 AND b.x = (a.x + 1 - o.j + 32) % 32 - 1 GROUP BY a.z, a.y, a.x")
add("deconvolve_fft", lambda g: A.deconvolve_fft(g, np.ones((3, 3)) / 9, None, 5), "H")

# -- older spellings, each against what it stands for -----------------------------------------------


def _same(name: str) -> str:
    return SQL[name].removeprefix(f"WITH {_ALL}\n")


for _n, _t in {"maximum": "maximum_filter", "minimum": "minimum_filter", "mean": "mean_filter", "median": "median", "variance": "variance_filter", "standard_deviation": "standard_deviation"}.items():
    add(f"{_n}_box", lambda g, f=A.OPERATORS[f"{_n}_box"]: f(g, 2, 2, 2), "H", _same(_t))
_SX, _SN = (_S1, "max(b.v)"), (_S1, "min(b.v)")
_OPENED, _CLOSED = chain("H", [_SN, _SX]), chain("H", [_SX, _SN])
for _n, _s in {
    "closing_box": _same("grayscale_closing"), "opening_box": _same("grayscale_opening"), "top_hat_box": _same("top_hat"), "bottom_hat_box": _same("bottom_hat"),
    "closing_sphere": _CLOSED, "opening_sphere": _OPENED, "top_hat_sphere": two("a.v - b.v", "H", f"({_OPENED})"), "bottom_hat_sphere": two("b.v - a.v", "H", f"({_CLOSED})"),
    "standard_deviation_sphere": near("H", _S1, "stddev_pop(b.v)"), "mode_box": _same("mode"),
    "mode_sphere": _same("mode").replace(", ".join(map(str, _B1)), ", ".join(map(str, _S1))),
    "laplace_box": _same("laplace"), "detect_maxima_box": _same("detect_maxima"), "detect_minima_box": _same("detect_minima"),
    "nonzero_maximum_box": _same("nonzero_maximum"), "nonzero_minimum_box": _same("nonzero_minimum"), "onlyzero_overwrite_maximum_box": _same("onlyzero_overwrite_maximum"),
    "nonzero_maximum_diamond": near("H", _S1, "CASE WHEN a.v <> 0 THEN max(b.v) ELSE 0.0 END"),
    "nonzero_minimum_diamond": near("H", _S1, "CASE WHEN a.v <> 0 THEN min(b.v) FILTER (WHERE b.v <> 0) ELSE 0.0 END"),
    "onlyzero_overwrite_maximum_diamond": near("H", _S1, "CASE WHEN a.v = 0 THEN max(b.v) ELSE a.v END"),
}.items():
    add(_n, A.OPERATORS[_n], "H", _s)
for _n, _o in {"dilate_box": (_B1, "max"), "dilate_sphere": (_S1, "max"), "erode_box": (_B1, "min"), "erode_sphere": (_S1, "min")}.items():
    add(_n, A.OPERATORS[_n], "B", near("B", _o[0], f"{_o[1]}(b.v)"))
add("replace_intensity", lambda g: A.replace_intensity(g, 0, 5), "Q", _same("replace_value"))
add("replace_intensities", lambda g: A.replace_intensities(g, _table(g)), "L", _same("replace_values"))
add("connected_components_labeling", A.connected_components_labeling, "B")
for _n, _t in {"exclude_labels_with_map_values_out_of_range": "remove_labels_with_map_values_out_of_range", "exclude_labels_with_map_values_within_range": "remove_labels_with_map_values_within_range"}.items():
    add(_n, lambda g, f=A.OPERATORS[_n]: f(g, _table(g), 2, 4), "L", _same(_t))
for _n, _t in {
    "generate_touch_count_matrix": "generate_touching_area_matrix", "generate_touch_portion_matrix": "generate_partial_touching_area_matrix",
    "standard_deviation_touch_portion": "standard_deviation_partial_touching_area_matrix", "label_pixel_count_map": "pixel_count_map",
}.items():
    add(_n, A.OPERATORS[_n], "L", _same(_t))
add("generate_touch_portion_within_range_neighbors_matrix", lambda g: A.generate_touch_portion_within_range_neighbors_matrix(A.generate_touch_portion_matrix(g), 0.2, 0.4), "L", _same("generate_partial_touching_area_matrix_within_range"))
add("average_distance_touching_neighbors", lambda g: A.average_distance_touching_neighbors(A.centroid_distances(g), A.generate_touch_matrix(g)), "L", _same("mean_distance_touching_neighbors"))
for _n, _t in {
    "average_distance_of_n_nearest_distances": "mean_distance_n_nearest_neighbors", "maximum_distance_of_n_shortest_distances": "maximum_distance_n_nearest_neighbors",
    "average_distance_of_n_far_off_distances": "mean_distance_n_farthest_neighbors",
}.items():
    add(_n, lambda g, f=A.OPERATORS[_n]: f(A.centroid_distances(g), 3), "L", _same(_t))
add("read_intensities_from_map", lambda h, g: A.read_intensities_from_map(g, h), "HL", _same("read_map_values"))
_PLAIN = ("label", "area", "min_intensity", "max_intensity", "sum_intensity", "mean_intensity", "standard_deviation_intensity")
_STAT = "SELECT i.i AS label, CAST(count(x) AS DOUBLE) AS area, " + ", ".join(f"round(coalesce({a}, 0), 5) + 0.0 AS {n}_intensity" for n, a in (("min", "min(w)"), ("max", "max(w)"), ("sum", "sum(w)"), ("mean", "avg(w)"), ("standard_deviation", "stddev_pop(w)")))
_STAT += " FROM range({first}, 129) i(i) LEFT JOIN (SELECT L.v, L.x, CAST(H.v AS DOUBLE) AS w FROM L JOIN H USING (z, y, x)) l ON l.v = i.i GROUP BY i.i"
add("statistics_of_labelled_pixels", lambda h, g: A.statistics_of_labelled_pixels(h, g).select(*_PLAIN), "HL", _STAT.format(first=1))
add("statistics_of_background_and_labelled_pixels", lambda h, g: A.statistics_of_background_and_labelled_pixels(h, g).select(*_PLAIN), "HL", _STAT.format(first=0))
add("label_mean_intensity_map", lambda h, g, f=A.label_mean_intensity_map: f(h, g), "HL", _same("mean_intensity_map"))
add("statistics_of_labelled_neighbors", lambda g: A.statistics_of_labelled_neighbors(g, (10,), (2,), (1,)), "L")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells above the Otsu threshold of H for each row."""
    mask = A.threshold_otsu(grid_h(spark, sf_dir))
    return mask.df.groupBy("y").agg(F.sum("v").cast("long").alias("cells")).orderBy("y")


def _flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).select(F.col("y").cast("long").alias("y"), "cells")


QUERIES["otsu_rows"] = _flag
SQL["otsu_rows"] = f"WITH {_ALL}{with_bins(_OTSU)}SELECT CAST(y AS BIGINT) AS y, CAST(sum(CASE WHEN v > threshold THEN 1 ELSE 0 END) AS BIGINT) AS cells FROM H, t GROUP BY y"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


#: Queries whose result has no column v.
NO_V = {
    "maximum_position", "minimum_position", "bounding_box", "label_bounding_box", "center_of_mass", "spots_to_pointlist", "labelled_spots_to_pointlist",
    "centroids_of_labels", "labels_statistics", "histogram", "otsu_rows", "statistics_of_labelled_pixels", "statistics_of_background_and_labelled_pixels",
}


def oracle_sql() -> dict[str, str]:
    """Values are doubles on both sides, also where SQL would make a decimal."""
    return {name: sql if name in NO_V else f"SELECT * REPLACE (CAST(v AS DOUBLE) AS v) FROM (\n{sql}\n)" for name, sql in SQL.items()}


