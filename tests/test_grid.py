"""Small arrays with known results, and properties of the operators."""

import math

import numpy as np
import pytest

from gridweave import api as A
from gridweave.sources import from_numpy, to_numpy

IMPULSE = np.zeros((5, 5))
IMPULSE[2, 2] = 1
LABELS = np.array([[1, 1, 0, 0, 3], [1, 1, 0, 0, 3], [0, 0, 0, 0, 0], [2, 2, 0, 4, 4], [2, 2, 0, 4, 4]])
REGIONS = np.array([[0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1], [0, 0, 0, 3, 1, 1], [0, 2, 2, 2, 1, 1], [0, 2, 2, 2, 1, 1], [0, 2, 2, 1, 1, 1]])
BOX_MODE = np.array([[0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1], [0, 0, 2, 2, 1, 1], [0, 2, 2, 2, 1, 1], [0, 2, 2, 1, 1, 1]])
BLOBS = np.array([[0, 0, 1, 1, 0, 0], [0, 0, 8, 9, 0, 0], [0, 0, 8, 9, 0, 0], [0, 0, 1, 1, 0, 0], [0, 10, 0, 0, 0, 0], [8, 9, 1, 0, 0, 0], [0, 8, 0, 0, 0, 0]])


@pytest.fixture
def grid(spark):
    return lambda a, dtype="FLOAT": from_numpy(spark, np.array(a), dtype)


def plane(g):
    return to_numpy(g)[0]


def test_ieee_arithmetic(grid):
    out = plane(A.logarithm(grid([[0.0, -1.0, 1.0]])))[0]
    assert out[0] == -math.inf and math.isnan(out[1]) and out[2] == 0
    assert plane(A.reciprocal(grid([[0.0, 2.0]])))[0].tolist() == [math.inf, 0.5]
    assert math.isnan(plane(A.modulo_images(grid([[5.0]]), grid([[0.0]])))[0, 0])
    assert plane(A.equal(grid([[math.nan, 1]]), grid([[math.nan, 1]])))[0].tolist() == [0, 1]
    assert plane(A.nan_to_num(grid([[-math.inf, math.inf, math.nan, 0]]), 3, 4, 5))[0].tolist() == [5, 4, 3, 0]


def test_integers_saturate_and_round_to_even(grid):
    assert plane(A.add_image_and_scalar(grid([[250, 1]], "UINT8"), 10.5))[0].tolist() == [255, 12]
    assert plane(A.copy(grid([[-2.7, 300.2]]), "UINT8"))[0].tolist() == [0, 255]


def test_size_one_axes_are_broadcast(grid):
    assert plane(A.multiply_images(grid([[1, 2], [3, 4]]), grid([[10, 100]]))).tolist() == [[10, 200], [30, 400]]


def test_gaussian_and_gradients(grid):
    blurred = plane(A.gaussian_blur(grid(IMPULSE * 100), 1, 1, 1))
    assert np.allclose([blurred[2, 2], blurred[2, 3], blurred[4, 4]], [15.9156, 9.6533, 0.2915], atol=1e-4)
    assert np.allclose(plane(A.sobel(grid(IMPULSE)))[1:3, 1:3], [[2**0.5, 2], [2, 0]])
    assert plane(A.convolve(grid(np.diag([1, 1, 2, 1])), np.eye(3)))[:2].tolist() == [[3, 1, 0, 0], [1, 4, 0, 0]]


def test_variance(grid):
    assert plane(A.variance_filter(grid(IMPULSE), 1, 1, 1))[2, 2] == pytest.approx(8 / 81)
    assert plane(A.variance_sphere(grid(IMPULSE)))[2, 2] == pytest.approx(0.16)


@pytest.mark.parametrize(("scale", "dtype"), [(1, "UINT8"), (1000, "FLOAT"), (0.25, "FLOAT"), (70000, "UINT32")])
def test_mode_of_any_value(grid, scale, dtype):
    got = A.mode(grid(REGIONS * scale, dtype))
    assert got.dtype == dtype and plane(got).tolist() == (BOX_MODE * scale).tolist()


def test_mode_box_of_large_values(grid):
    assert plane(A.mode_box(grid(REGIONS * 1000))).tolist() == (BOX_MODE * 1000).tolist()


def test_mode_sphere_of_large_values(grid):
    want = BOX_MODE.copy()
    want[3, 1] = 2
    assert plane(A.mode_sphere(grid(REGIONS * 1000))).tolist() == (want * 1000).tolist()


def test_mode_of_nan_and_negative_values(grid):
    assert np.array_equal(plane(A.mode(grid([[math.nan, math.nan, -1.5, -300, -300]])))[0], [math.nan, math.nan, -300, -300, -300], equal_nan=True)


def test_mean_box_in_3d(grid):
    a = np.zeros((3, 5, 5))
    a[1, 2, 2] = 27
    assert np.allclose(to_numpy(A.mean_filter(grid(a), 1, 1, 1))[:, 1:4, 1:4], 1)


def test_tiles_do_not_show(grid):
    from gridweave.plans.tiles import box, shifts, stencil

    a = np.random.default_rng(0).random((3, 9, 11))
    g = grid(a)
    fn = lambda b: np.stack(shifts(b, (1, 1, 1), box((1, 1, 1), (11, 9, 3)))).max(0)
    assert np.allclose(to_numpy(stencil(g, (1, 1, 1), fn, tile=(4, 4, 2))), to_numpy(A.maximum_filter(g, 1, 1, 1)))


def test_thresholds_and_percentiles(grid):
    ramp = grid(np.arange(1, 13).reshape(2, 2, 3))
    assert to_numpy(A.threshold_otsu(ramp)).sum() == 6
    assert to_numpy(A.threshold_yen(ramp)).sum() == 6
    assert A.percentile(grid(np.arange(10), "UINT32"), 50) == 4
    assert A.percentile(grid(np.arange(10) / 10), 50) == pytest.approx(0.4, abs=0.01)
    assert np.allclose(plane(A.normalize(grid(np.arange(11)), 10, 90))[0], [0, 0, *(np.arange(1, 8) / 8), 1, 1])


def test_coordinates(grid):
    assert plane(A.circular_shift(grid(np.arange(1, 13).reshape(3, 4)), 2, 2))[0].tolist() == [7, 8, 5, 6]
    rows = grid(np.repeat(np.arange(1, 7), 6).reshape(6, 6))
    assert plane(A.range(rows, None, None, None, 5, None, -2))[:, 0].tolist() == [6, 4, 2]
    assert plane(A.concatenate_along_x(grid([[1, 2]]), grid([[3]])))[0].tolist() == [1, 2, 3]
    g = grid(np.arange(24).reshape(2, 3, 4))
    assert np.array_equal(to_numpy(A.flip(A.flip(g))), to_numpy(g))
    assert np.array_equal(to_numpy(A.transpose_xz(A.transpose_xz(g))), to_numpy(g))
    assert np.array_equal(to_numpy(A.unpad(A.pad(g, 8, 7, 4, 5, True), 4, 3, 2, True)), to_numpy(g))


@pytest.mark.parametrize("tile", [(64, 64, 16), (2, 2, 1)])
def test_components(grid, tile):
    assert np.array_equal(plane(A.connected_component_labeling(grid(LABELS > 0), tile=tile)), [[1, 1, 0, 0, 2], [1, 1, 0, 0, 2], [0] * 5, [3, 3, 0, 4, 4], [3, 3, 0, 4, 4]])
    cross = [[1, 0, 1], [0, 1, 0], [1, 0, 1]]
    assert plane(A.connected_component_labeling(grid(cross), "sphere", tile=tile)).max() == 5
    assert plane(A.connected_component_labeling(grid(cross), "box", tile=tile)).max() == 1


def test_label_growth(grid):
    full = [[1, 1, 1, 3, 3], [1, 1, 1, 3, 3], [2, 2, 4, 4, 4], [2, 2, 4, 4, 4], [2, 2, 4, 4, 4]]
    assert plane(A.extend_labeling_via_voronoi(grid(LABELS))).tolist() == full
    assert plane(A.merge_touching_labels(grid([[1, 2, 0, 3]])))[0].tolist() == [1, 1, 0, 2]


def test_flagship_pipelines(grid):
    spots = plane(A.voronoi_otsu_labeling(grid(BLOBS), 1, 1))
    assert spots.max() == 2 and spots[1, 2] != spots[5, 0]
    assert plane(A.gauss_otsu_labeling(grid(BLOBS), 1)).max() == 1


def test_statistics(grid):
    rows = {r["label"]: r for r in A.labels_statistics(grid(LABELS), grid(LABELS * 2)).collect()}
    assert len(rows[1]) == 36 and rows[1]["area"] == 4 and rows[3]["area"] == 2 and rows[4]["mean_intensity"] == 8
    assert A.labels_statistics(grid([[0, 2]]), None).filter("area = 0").count() == 1


def test_touching_neighbours(grid):
    labels, values = grid([[1, 2], [3, 4]]), grid([[1, 2], [3, 2]])
    assert np.allclose(plane(A.mean_of_touching_neighbors_map(values, labels)), [[2, 5 / 3], [2, 7 / 3]])
    assert plane(A.mode_of_touching_neighbors_map(values, labels)).tolist() == [[2, 1], [1, 2]]


def test_transforms(grid):
    assert np.argwhere(plane(A.scale(grid(IMPULSE), 1, 2, 1))).tolist() == [[1, 2], [2, 2]]
    big = plane(A.affine_transform(grid(IMPULSE), [2, 0, 0, 0, 2, 0, 0, 0, 1], True, True))
    assert big.shape == (10, 10) and np.allclose(big[3:5, 3:5], [[0.0625, 0.1875], [0.1875, 0.5625]])
    assert np.argwhere(plane(A.translate(grid(IMPULSE), 1, -1))).tolist() == [[1, 3]]


def test_spectra(grid):
    g = grid(np.arange(50).reshape(5, 10))
    assert np.allclose(plane(A.ifft(A.fft(g), (10, 5, 1))), np.arange(50).reshape(5, 10))
    k = np.array([[0, 0, 0], [0, 0, 1], [0, 0, 0]])
    assert np.argwhere(plane(A.convolve_fft(grid(IMPULSE), k)) > 0.5).tolist() == [[2, 3]]


# The image, and the contours after twenty steps without and with smoothing, a digit for each voxel.
CONTOUR_IMAGE = """
00000000000000
00000000000000
00000000000000
00000055000000
00005577500000
00005799750000
00005799750000
00005799700000
00005799500000
00000577500000
00000055000000
00000000000000
00000000000000
00000000000000
"""
CONTOUR_PLAIN = """
11111111111111
11111111111111
11111111111111
11111100111111
11110000011111
11110000001111
11110000001111
11110000011111
11110000011111
11111000011111
11111100111111
11111111111111
11111111111111
11111111111111
"""
CONTOUR_SMOOTH = """
00111111111100
01111111111110
11111111111111
11111101111111
11111000011111
11110000011111
11110000001111
11110000011111
11111000011111
11111000111111
11111111111111
11111111111111
01111111111110
00111111111100
"""


def digits(text):
    return [[int(c) for c in row] for row in text.split()]


@pytest.mark.parametrize(("smoothing", "want"), [(0, CONTOUR_PLAIN), (1, CONTOUR_SMOOTH)])
def test_contours(grid, smoothing, want):
    assert plane(A.morphological_chan_vese(grid(digits(CONTOUR_IMAGE)), 20, smoothing)).tolist() == digits(want)


def test_kernel_origin_of_spectra(grid):
    one, two = np.zeros((3, 3)), np.zeros((3, 3))
    one[1, 1] = 1
    two[1, 1:] = 1, 2
    kernel = np.zeros((3, 3))
    kernel[0, :2] = 1, 2
    assert np.allclose(plane(A.convolve_fft(grid(one), np.array([[1, 2]]))), two, atol=1e-6)
    peak = plane(A.deconvolve_fft(grid(two), kernel, None, 100))
    assert np.allclose(peak, 3 * one, atol=0.1)
    with pytest.raises(ValueError):
        A.convolve_fft(grid(one), np.ones((4, 1)))


# A quarter of the large eigenvalue, and of the response of two sigmas, of a line of five voxels in 11 x 11.
HESSIAN_2 = """
2.80377432e-03 5.15507488e-03 8.01434834e-03 1.07877254e-02 1.28035750e-02 1.35410940e-02
6.33742381e-03 1.08882710e-02 1.57999620e-02 2.00331286e-02 2.28355490e-02 2.38104817e-02
1.09319249e-02 1.68837775e-02 2.15000007e-02 2.36747041e-02 2.39554476e-02 2.37844288e-02
1.47780655e-02 1.94353256e-02 1.88947730e-02 1.27731506e-02 4.42769844e-03 2.56299973e-06
1.66362859e-02 1.80286150e-02 1.01901442e-02 -5.19440044e-03 -2.14566216e-02 -3.01977620e-02
1.70330275e-02 1.66780371e-02 5.62216528e-03 -1.25080058e-02 -2.82402784e-02 -3.42185497e-02
"""
SATO_1_2 = """
0.0011887 0.00242649 0.00393715 0.00519269 0.00584239 0.00600314
0.00375564 0.00768017 0.01244524 0.01629806 0.01813266 0.01851889
0.00924682 0.01906006 0.03103951 0.04041484 0.04409751 0.0444351
0.01778684 0.03727557 0.06193392 0.08143086 0.08621543 0.08301813
0.02657181 0.05695897 0.09860913 0.13834752 0.15796456 0.1550932
0.03044875 0.06605215 0.11738712 0.17370851 0.21772212 0.23432663
"""
# The rows above and in the middle of a point's slope along x, sigma 1.
SLOPE = [[0.00518165, 0.0116113, 0, -0.0116113, -0.00518165], [0.0232225, 0.0520381, 0, -0.0520381, -0.0232225], [0.0382875, 0.0857963, 0, -0.0857963, -0.0382875]]


def test_gaussian_derivatives(grid):
    quarter = lambda text: np.array([[float(v) for v in row.split()] for row in text.strip().split("\n")])
    line = np.zeros((11, 11))
    line[5, 3:8] = 1
    assert np.allclose(plane(A.gaussian_derivative(grid(IMPULSE), 1, 1, 1, 1, 0, 0))[:3], SLOPE, atol=1e-6)
    large, small = (plane(g) for g in A.hessian_gaussian_eigenvalues(grid(line), 2))
    assert np.allclose(large[:6, :6], quarter(HESSIAN_2), atol=1e-6) and (large >= small).all()
    assert np.allclose(plane(A.sato_filter(grid(line), 1, 3, 1))[:6, :6], quarter(SATO_1_2), atol=1e-6)
    assert np.allclose(plane(A.tubeness(grid(line), 2)), plane(A.sato_filter(grid(line), 2, 3, 1)))


def test_nonzero_neighbours(grid):
    image = [[0, 0, 0, 0, 0], [0, 1, 1, 2, 0], [0, 2, 2, 3, 0], [0, 3, 3, 4, 0], [0, 0, 0, 0, 0]]
    box = [[0, 0, 0, 0, 0], [0, 2, 3, 3, 0], [0, 3, 4, 4, 0], [0, 3, 4, 4, 0], [0, 0, 0, 0, 0]]
    diamond = [[0, 0, 0, 0, 0], [0, 2, 2, 3, 0], [0, 3, 3, 4, 0], [0, 3, 4, 4, 0], [0, 0, 0, 0, 0]]
    assert plane(A.nonzero_maximum_box(grid(image))).tolist() == box and plane(A.nonzero_maximum_diamond(grid(image))).tolist() == diamond
    # a zero between two numbers, and at the edge
    assert plane(A.nonzero_maximum(grid([[9, 0, 4, 0, 5]]), "sphere"))[0].tolist() == [9, 0, 4, 0, 5]
    assert plane(A.nonzero_minimum(grid([[3, 0, 4, 5, 0]]), "sphere"))[0].tolist() == [3, 0, 4, 4, 0]


def test_ids_in_pieces(spark, monkeypatch):
    from gridweave.operators import labels

    monkeypatch.setattr(labels, "IDS", 4)
    for top, first in ((10, 1), (3, 1), (4, 0), (0, 0), (0, 1)):
        got = [r[0] for r in labels.ids_up_to(spark.createDataFrame([(top,)], "top long"), first).collect()]
        assert sorted(got) == list(range(first, top + 1))


NESTED = np.array([[1, 1, 2, 2, 3, 3, 3, 3]] * 2 + [[1, 1, 7, 7, 7, 7, 3, 3]] * 2 + [[6, 6, 7, 7, 7, 7, 4, 4]] * 2 + [[5, 5, 5, 5, 5, 5, 4, 4]] * 2)


def test_neighbour_statistics(grid):
    out = A.labels_neighbors_statistics(grid(np.kron(NESTED, np.ones((10, 10))), "UINT32"), (20, 40), (1, 2, 3, 4, 5, 6), ())
    rows = {r["label"]: r.asDict() for r in out.collect()}
    want = {
        "touching_neighbor_count": 6, "maximum_distance_of_touching_neighbors": 36.055511, "average_distance_of_touching_neighbors": 33.329613,
        "minimum_distance_of_touching_neighbors": 31.622776, "proximal_neighbor_count_d20": 0, "proximal_neighbor_count_d40": 6,
        "maximum_distance_of_n1_nearest_neighbors": 31.622776, "maximum_distance_of_n4_nearest_neighbors": 32.998318, "maximum_distance_of_n6_nearest_neighbors": 36.055511,
        "touch_count_sum": 160, "minimum_touch_count": 20, "maximum_touch_count": 40, "minimum_touch_portion": 0.125, "maximum_touch_portion": 0.25,
        "touch_portion_above_0.000000_neighbor_count": 6,
    }
    for name, value in want.items():
        assert rows[7][name] == pytest.approx(value, abs=1e-3), name
    assert max(r["maximum_distance_of_touching_neighbors"] for r in rows.values()) == pytest.approx(43.843155, abs=1e-3)


@pytest.mark.parametrize("axis", [0, 1])
def test_deskew_reads_between_voxels(spark, axis):
    """Each voxel of the result is the linear blend of the voxels round its place before the transform."""
    from gridweave.operators.transforms import AffineTransform, resized
    from gridweave.sources import from_numpy

    a = np.random.default_rng(axis).random((6, 5, 7))
    g = from_numpy(spark, a)
    t = AffineTransform().deskew(axis, 30, (1.0, 1.0, 1.0), 1.0)
    got = to_numpy((A.deskew_x, A.deskew_y)[axis](g, 30, 1, 1, 1, 1))
    size, moved = resized(g.shape, t)
    assert got.shape == size[::-1]
    inv, want = moved.inverse, np.zeros(got.shape)
    for z, y, x in np.ndindex(want.shape):
        p = (inv @ np.array([x + 0.5, y + 0.5, z + 0.5, 1]))[:3] - 0.5
        lo = np.floor(p + 1e-9).astype(int)
        f = p - lo
        for o in np.ndindex(2, 2, 2):
            i, j, k = lo + o
            if 0 <= i < 7 and 0 <= j < 5 and 0 <= k < 6:
                want[z, y, x] += a[k, j, i] * np.prod(np.where(o, f, 1 - f))
    assert np.allclose(got, want, atol=1e-6)


def test_evaluate(grid):
    assert plane(A.evaluate("a > 2 ? a * b : pow(a, 2)", [grid([[1, 2, 3]]), 3.0]))[0].tolist() == [1, 4, 9]
    with pytest.raises(ValueError):
        A.evaluate("a +", [grid([[1]])])


def test_opening_lies_below_and_closing_above(grid):
    a = np.random.default_rng(1).integers(0, 9, (7, 8))
    g = grid(a)
    assert (plane(A.grayscale_opening(g)) <= a).all() and (plane(A.grayscale_closing(g)) >= a).all()


def test_relabel_keeps_order(grid):
    once = A.relabel_sequential(grid([[0, 5, 9, 5, 2]]))
    assert plane(once)[0].tolist() == [0, 2, 3, 2, 1] == plane(A.relabel_sequential(once))[0].tolist()


def test_projections_keep_the_sum(grid):
    g = grid(np.arange(24).reshape(2, 3, 4))
    for axis in "xyz":
        assert A.sum_of_all_pixels(A.OPERATORS[f"sum_{axis}_projection"](g)) == 276
    assert A.maximum_position(grid([[1, 5], [5, 0]])) == [1, 0, 0]


def test_every_operator_has_a_query():
    from gridweave import catalog

    assert len(catalog.queries()) > 300 and set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", ["otsu_rows", "mean_filter", "labels_statistics", "gradient_z", "relabel_sequential"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from gridweave import catalog

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.queries()[name](spark, sf).toPandas()
    want = con.sql(catalog.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns)
    assert np.allclose(got.sort_values(key).to_numpy(float), want.sort_values(key).to_numpy(float), atol=1e-5)


@pytest.mark.parametrize("name", ["mode", "mode_box", "mode_sphere"])
def test_oracle_of_large_counts(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from gridweave import catalog

    con = duckdb.connect()
    # days and users of 256 to 263 events each, in steps that give neighbours in common
    con.sql("CREATE TABLE events AS SELECT u AS user_id, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INT)) AS ts FROM range(6) a(u), range(8) b(d), range(263) c(i) WHERE i < 256 + (u // 2 + 3 * (d // 3)) % 8")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    for t in ("embeddings", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(catalog.oracle_sql()[name]).fetchall()) and max(v for *_, v in got) > 256


def test_stream_of_images(spark, tmp_path):
    from gridweave.streaming import each_image

    rows = [(i, 0, y, x, float(i + x)) for i in (1, 2) for y in range(2) for x in range(3)]
    spark.createDataFrame(rows, "img int, z int, y int, x int, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("img int, z int, y int, x int, v double").parquet(f"{tmp_path}/in")
    query = each_image(stream, (3, 2, 1), lambda g: A.multiply_image_and_scalar(g, 2), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").count() == 12
