"""Coordinate rewriting: slices, flips, shifts, pads, concatenation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.grid import AXES, KEYS, Grid, densify, positions
from gridweave.operators.support import pair, V, X, Y, Z
from gridweave.sources.arrays import write_region



def _rekey(src: Grid, x: Column, y: Column, z: Column, shape: tuple[int, int, int]) -> Grid:
    return Grid(src.df.select(z.cast("int").alias("z"), y.cast("int").alias("y"), x.cast("int").alias("x"), "v"), shape, src.dtype)


def crop(src: Grid, start_x: int = 0, start_y: int = 0, start_z: int = 0, width: int = 1, height: int = 1, depth: int = 1) -> Grid:
    """A box of the grid; voxels outside the grid are 0."""
    start, size = (start_x, start_y, start_z), (max(1, width), max(1, height), max(1, depth))
    inside = src.df
    for axis, a, n in zip(AXES, start, size, strict=True):
        inside = inside.filter((F.col(axis) >= a) & (F.col(axis) < a + n))
    out = _rekey(Grid(inside, src.shape, src.dtype), X() - start_x, Y() - start_y, Z() - start_z, size)
    if all(a >= 0 and a + n <= m for a, n, m in zip(start, size, src.shape, strict=True)):
        return out
    return densify(out.df, size, 0.0, src.dtype)


def crop_border(src: Grid, border_size: int = 1) -> Grid:
    """Drops voxels from both ends of every axis longer than 1."""
    b = [border_size if n > 1 else 0 for n in src.shape]
    return crop(src, *b, *(n - 2 * k for n, k in zip(src.shape, b, strict=True)))


def range(src: Grid, start_x: int | None = None, stop_x: int | None = None, step_x: int | None = None, start_y: int | None = None, stop_y: int | None = None, step_y: int | None = None, start_z: int | None = None, stop_z: int | None = None, step_z: int | None = None) -> Grid:  # noqa: A001
    """A strided slice as Python has it; a negative step reverses."""
    slices = [slice(start_x, stop_x, step_x), slice(start_y, stop_y, step_y), slice(start_z, stop_z, step_z)]
    out, df, shape = [], src.df, []
    for axis, s, n in zip(AXES, slices, src.shape, strict=True):
        start, stop, step = s.indices(n)
        count = max(0, -(-(stop - start) // step) if step > 0 else -(-(start - stop) // -step))
        c = F.col(axis)
        df = df.filter(((c - start) % step == 0) & ((c - start) * (1 if step > 0 else -1) >= 0) & ((c - stop) * (1 if step > 0 else -1) < 0))
        out.append(F.floor((c - start) / step))
        shape.append(count)
    return _rekey(Grid(df, src.shape, src.dtype), *out, tuple(max(1, n) for n in shape))


def paste(src: Grid, dst: Grid, destination_x: int = 0, destination_y: int = 0, destination_z: int = 0) -> Grid:
    """``dst`` with ``src`` written at an offset; what falls outside is dropped."""
    return write_region(dst, src, (destination_x, destination_y, destination_z))


def copy_slice(src: Grid, dst: Grid | None = None, slice_index: int = 0) -> Grid:
    """Plane ``slice_index`` of src; or src as that plane of a deeper ``dst``."""
    if dst is not None and dst.shape[2] > 1:
        return paste(crop(src, 0, 0, 0, src.shape[0], src.shape[1], 1), dst, 0, 0, slice_index)
    return crop(src, 0, 0, slice_index, src.shape[0], src.shape[1], 1)


def copy_horizontal_slice(src: Grid, dst: Grid | None = None, slice_index: int = 0) -> Grid:
    """Row ``slice_index`` of every plane as an image (x, z); or an image as those rows of ``dst``."""
    if dst is not None and dst.shape[2] > 1:
        row = _rekey(src, X(), F.lit(slice_index), Y(), (src.shape[0], 1, src.shape[1]))
        return write_region(dst, row)
    part = src.df.filter(Y() == slice_index)
    return _rekey(Grid(part, src.shape, src.dtype), X(), Z(), F.lit(0), (src.shape[0], src.shape[2], 1))


def copy_vertical_slice(src: Grid, dst: Grid | None = None, slice_index: int = 0) -> Grid:
    """Column ``slice_index`` of every plane as an image (z, y); or an image as those columns of ``dst``."""
    if dst is not None and dst.shape[2] > 1:
        column = _rekey(src, F.lit(slice_index), Y(), X(), (1, src.shape[1], src.shape[0]))
        return write_region(dst, column)
    part = src.df.filter(X() == slice_index)
    return _rekey(Grid(part, src.shape, src.dtype), Z(), Y(), F.lit(0), (src.shape[2], src.shape[1], 1))


def sub_stack(src: Grid, start_z: int = 0, end_z: int = 0) -> Grid:
    """Planes start_z to end_z, both included."""
    return crop(src, 0, 0, start_z, src.shape[0], src.shape[1], end_z - start_z + 1)


def reduce_stack(src: Grid, reduction_factor: int = 2, offset: int = 0) -> Grid:
    """Every n-th plane after an offset; floor(depth / n) planes."""
    n = src.shape[2] // reduction_factor
    at = F.floor((Z() - offset) / reduction_factor)
    part = src.df.filter((Z() >= offset) & ((Z() - offset) % reduction_factor == 0) & (at < n))
    return _rekey(Grid(part, src.shape, src.dtype), X(), Y(), at, (src.shape[0], src.shape[1], max(1, n)))


def flip(src: Grid, flip_x: bool = True, flip_y: bool = True, flip_z: bool = True) -> Grid:
    """Mirrors along the chosen axes."""
    w, h, d = src.shape
    return _rekey(src, w - 1 - X() if flip_x else X(), h - 1 - Y() if flip_y else Y(), d - 1 - Z() if flip_z else Z(), src.shape)


def circular_shift(src: Grid, shift_x: int = 0, shift_y: int = 0, shift_z: int = 0) -> Grid:
    """Rolls with wrap-around."""
    w, h, d = src.shape
    return _rekey(src, F.pmod(X() + shift_x, F.lit(w)), F.pmod(Y() + shift_y, F.lit(h)), F.pmod(Z() + shift_z, F.lit(d)), src.shape)


def transpose_xy(src: Grid) -> Grid:
    w, h, d = src.shape
    return _rekey(src, Y(), X(), Z(), (h, w, d))


def transpose_xz(src: Grid) -> Grid:
    w, h, d = src.shape
    return _rekey(src, Z(), Y(), X(), (d, h, w))


def transpose_yz(src: Grid) -> Grid:
    w, h, d = src.shape
    return _rekey(src, X(), Z(), Y(), (w, d, h))


def _offsets(a: tuple[int, ...], b: tuple[int, ...], center: bool) -> list[int]:
    return [math.ceil(abs(m - n) / 2) if center and max(m, n) > 1 else 0 for m, n in zip(a, b, strict=True)]


def pad(src: Grid, size_x: int = 0, size_y: int = 0, size_z: int = 0, value: float = 0, center: bool = False) -> Grid:
    """Enlarges with a constant, at the far ends or, centred, around."""
    shape = tuple(max(n, m) for n, m in zip(src.shape, (size_x, size_y, size_z), strict=True))
    ox, oy, oz = _offsets(src.shape, shape, center)
    return densify(_rekey(src, X() + ox, Y() + oy, Z() + oz, shape).df, shape, value, src.dtype)


def unpad(src: Grid, size_x: int = 0, size_y: int = 0, size_z: int = 0, center: bool = False) -> Grid:
    """Undoes ``pad``."""
    shape = tuple(max(1, m) for m in (size_x, size_y, size_z))
    return crop(src, *_offsets(src.shape, shape, center), *shape)


def concatenate(src0: Grid, src1: Grid, axis: int = 0) -> Grid:
    """Joins along an axis; where the other extents differ the rest is 0."""
    if axis not in (0, 1, 2):
        raise ValueError("axis must be 0, 1 or 2")
    shape = list(src0.shape)
    shape[axis] += src1.shape[axis]
    name = AXES[axis]
    moved = src1.df.withColumn(name, (F.col(name) + src0.shape[axis]).cast("int"))
    same = all(src0.shape[i] == src1.shape[i] for i in (0, 1, 2) if i != axis)
    rows = src0.df.select(*KEYS, "v").unionByName(moved.select(*KEYS, "v"))
    return Grid(rows, tuple(shape), src0.dtype) if same else densify(rows, tuple(shape), 0.0, src0.dtype)


def concatenate_along_x(src0: Grid, src1: Grid) -> Grid:
    return concatenate(src0, src1, 0)


def concatenate_along_y(src0: Grid, src1: Grid) -> Grid:
    return concatenate(src0, src1, 1)


def concatenate_along_z(src0: Grid, src1: Grid) -> Grid:
    return concatenate(src0, src1, 2)


def reshape(src: Grid, shape: tuple[int, int, int]) -> Grid:
    """Other extents over the same x-fastest order."""
    w, h, d = shape
    if w * h * d != src.size:
        raise ValueError("reshape keeps the number of voxels")
    i = src.linear()
    return _rekey(src, i % w, F.floor(i / F.lit(w)) % h, F.floor(i / F.lit(w * h)), shape)


def read_values_from_positions(src: Grid, points):
    """(id, v) for a list of points (id, x, y, z), each 0 outside the grid."""
    at = points.select("id", *(F.floor(c).cast("int").alias(c) for c in AXES))
    return at.join(src.df, KEYS, "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))


def write_values_to_positions(points, shape: tuple[int, int, int] | None = None, dtype: str = "FLOAT") -> Grid:
    """A zero grid with the points (x, y, z, v) written in; of equal positions the largest value stays.

    Without a shape the largest coordinates set it, which takes one small aggregate.
    """
    at = points.select(*(F.floor(c).cast("int").alias(c) for c in AXES), "v").groupBy(*KEYS).agg(F.max("v").alias("v"))
    if shape is None:
        r = at.agg(*(F.max(c) for c in AXES)).first()
        shape = tuple(int(m or 0) + 1 for m in r)
    return densify(at, shape, 0.0, dtype)


def select_planes(src: Grid, altitude: Grid) -> Grid:
    """For each (x, y) the value in the plane that ``altitude`` names."""
    flat = Grid(altitude.df.filter("z = 0"), (altitude.shape[0], altitude.shape[1], 1), altitude.dtype)
    picked = pair(src, flat).filter(F.col("z") == F.floor("w")).select(F.lit(0).alias("z"), "y", "x", "v")
    w, h, _ = src.shape
    return Grid(positions(src.spark, (w, h, 1)).join(picked, KEYS, "left").select(*KEYS, F.coalesce("v", F.lit(0.0)).alias("v")), (w, h, 1), src.dtype)
