"""Affine transforms: inverse coordinates of the output voxels, then a gather."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from gridweave.grid import KEYS, Grid, positions, shape3


class AffineTransform:
    """A 4 x 4 matrix on the driver; later steps apply after earlier ones."""

    def __init__(self, matrix: np.ndarray | None = None) -> None:
        self.matrix = np.eye(4) if matrix is None else np.asarray(matrix, float).reshape(4, 4)

    def then(self, m: np.ndarray) -> AffineTransform:
        self.matrix = m @ self.matrix
        return self

    def scale(self, x: float, y: float, z: float) -> AffineTransform:
        return self.then(np.diag([x, y, z, 1.0]))

    def translate(self, x: float, y: float, z: float) -> AffineTransform:
        m = np.eye(4)
        m[:3, 3] = x, y, z
        return self.then(m)

    def rotate(self, axis: int, degrees: float) -> AffineTransform:
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        c, s = (0.0 if abs(v) < np.finfo(np.float32).eps else v for v in (c, s))
        i, j = ((1, 2), (2, 0), (0, 1))[axis]
        m = np.eye(4)
        m[i, i] = m[j, j] = c
        m[i, j], m[j, i] = -s, s
        return self.then(m)

    def center(self, shape: tuple[int, int, int], undo: bool = False) -> AffineTransform:
        return self.translate(*((1 if undo else -1) * (n / 2 if n != 1 else 0) for n in shape))

    def shear(self, plane: int, first: float, second: float) -> AffineTransform:
        """Shear in the x, y or z plane (0 to 2) by two angles of -90 to 90 degrees."""
        if not all(-90 <= a <= 90 for a in (first, second)):
            raise ValueError("shear angles lie between -90 and 90 degrees")
        i, j = ((1, 2), (0, 2), (0, 1))[plane]
        m = np.eye(4)
        m[i, j], m[j, i] = (1 / math.tan(math.radians(90 - a)) if a else 0.0 for a in (first, second))
        self.matrix = self.matrix @ m
        return self

    def deskew(self, axis: int, angle: float, voxel: tuple[float, float, float], factor: float = 1.0) -> AffineTransform:
        """Light-sheet deskew along x (0) or y (1)."""
        self.matrix[axis, 2] += math.sin(math.radians(90 - angle)) * voxel[2] / voxel[axis]
        self.scale(factor, factor, math.sin(math.radians(angle)) * voxel[2] / voxel[axis] * factor)
        return self.rotate(1, angle) if axis == 0 else self.rotate(0, -angle)

    @property
    def inverse(self) -> np.ndarray:
        return np.linalg.inv(self.matrix)

    @property
    def transpose(self) -> np.ndarray:
        return self.matrix.T


def resized(shape: tuple[int, int, int], t: AffineTransform) -> tuple[tuple[int, int, int], AffineTransform]:
    """The rounded box round the eight moved corners, and the transform shifted to its origin."""
    corners = np.array([[*c, 1.0] for c in product(*((0, n) for n in shape))])
    moved = (t.matrix @ corners.T)[:3]
    lo, hi = moved.min(1), moved.max(1)
    size = shape3(tuple(int(math.floor(v + 0.5)) for v in hi - lo))
    return size, AffineTransform(t.matrix).translate(*(-lo))


def apply_transform(src: Grid, t: AffineTransform, interpolate: bool = False, resize: bool = False) -> Grid:
    """Reads each output voxel at its place before the transform; outside the grid there is 0."""
    shape = src.shape
    if resize:
        shape, t = resized(shape, t)
    inv = t.inverse
    out = positions(src.spark, shape)
    p = [F.col(a) + 0.5 for a in "xyz"]
    at = [sum((float(inv[i, j]) * p[j] for j in range(3)), F.lit(float(inv[i, 3]))) for i in range(3)]
    values = src.df.select(*(F.col(k).alias(f"s{k}") for k in KEYS), "v")
    if not interpolate:
        near = out.withColumns({f"s{a}": F.floor(F.round(c, 9)).cast("int") for a, c in zip("xyz", at, strict=True)})
        got = near.join(values, ["sz", "sy", "sx"], "left").select(*KEYS, F.coalesce("v", F.lit(0.0)).alias("v"))
        return Grid(got, shape, src.dtype)
    flat = [n == 1 for n in src.shape]
    cols = {f"c{a}": (F.lit(0.0) if one else F.round(c - 0.5, 9)) for a, c, one in zip("xyz", at, flat, strict=True)}
    near = out.withColumns(cols)
    corners = []
    for o in product(*((0,) if one else (0, 1) for one in flat)):
        share = F.lit(1.0)
        for a, k, one in zip("xyz", o, flat, strict=True):
            if not one:
                f = F.col(f"c{a}") - F.floor(F.col(f"c{a}"))
                share = share * (f if k else 1 - f)
        corners.append(F.struct(*((F.floor(F.col(f"c{a}")) + k).cast("int").alias(f"s{a}") for a, k in zip("xyz", o, strict=True)), share.alias("share")))
    parts = near.select(*KEYS, F.explode(F.array(*corners)).alias("q")).select(*KEYS, "q.*").filter("share > 0")
    got = parts.join(values, ["sz", "sy", "sx"], "left").groupBy(*KEYS).agg(F.sum(F.coalesce("v", F.lit(0.0)) * F.col("share")).alias("v"))
    return Grid(got, shape, src.dtype).map(F.col("v"))


def affine_transform(src: Grid, transform_matrix: list[float] | None = None, interpolate: bool = False, resize: bool = False) -> Grid:
    """Any 3 x 3 (planar) or 4 x 4 matrix, row by row."""
    m = np.eye(4)
    if transform_matrix is not None:
        a = np.asarray(transform_matrix, float)
        if a.size == 9:
            a = a.reshape(3, 3)
            m[:2, :2], m[:2, 3] = a[:2, :2], a[:2, 2]
        elif a.size == 16:
            m = a.reshape(4, 4)
        else:
            raise ValueError("a transform matrix has 9 or 16 numbers")
    return apply_transform(src, AffineTransform(m), interpolate, resize)


def rigid_transform(src: Grid, translate_x: float = 0, translate_y: float = 0, translate_z: float = 0, angle_x: float = 0, angle_y: float = 0, angle_z: float = 0, centered: bool = True, interpolate: bool = False, resize: bool = False) -> Grid:
    t = AffineTransform()
    if centered:
        t.center(src.shape)
    for axis, angle in enumerate((angle_x, angle_y, angle_z)):
        if angle:
            t.rotate(axis, angle)
    if centered:
        t.center(src.shape, True)
    return apply_transform(src, t.translate(translate_x, translate_y, translate_z), interpolate, resize)


def rotate(src: Grid, angle_x: float = 0, angle_y: float = 0, angle_z: float = 0, centered: bool = True, interpolate: bool = False, resize: bool = False) -> Grid:
    return rigid_transform(src, 0, 0, 0, angle_x, angle_y, angle_z, centered, interpolate, resize)


def scale(src: Grid, factor_x: float = 1, factor_y: float = 1, factor_z: float = 1, centered: bool = True, interpolate: bool = False, resize: bool = False) -> Grid:
    t = AffineTransform()
    if centered and not resize:
        t.center(src.shape)
    t.scale(factor_x, factor_y, factor_z)
    if centered and not resize:
        t.center(src.shape, True)
    return apply_transform(src, t, interpolate, resize)


def translate(src: Grid, translate_x: float = 0, translate_y: float = 0, translate_z: float = 0, interpolate: bool = False) -> Grid:
    return apply_transform(src, AffineTransform().translate(translate_x, translate_y, translate_z), interpolate)


def deskew_x(src: Grid, angle: float = 30, voxel_size_x: float = 1.0, voxel_size_y: float = 1.0, voxel_size_z: float = 1.0, scale_factor: float = 1.0) -> Grid:
    t = AffineTransform().deskew(0, angle, (voxel_size_x, voxel_size_y, voxel_size_z), scale_factor)
    return apply_transform(src, t, True, True)


def deskew_y(src: Grid, angle: float = 30, voxel_size_x: float = 1.0, voxel_size_y: float = 1.0, voxel_size_z: float = 1.0, scale_factor: float = 1.0) -> Grid:
    t = AffineTransform().deskew(1, angle, (voxel_size_x, voxel_size_y, voxel_size_z), scale_factor)
    return apply_transform(src, t, True, True)


def make_isotropic(src: Grid, current_spacing_x: float = 1.0, current_spacing_y: float = 1.0, current_spacing_z: float = 1.0, target_spacing: float = -1.0, interpolate: bool = True) -> Grid:
    """Rescales to one spacing, by default the smallest."""
    now = (current_spacing_x, current_spacing_y, current_spacing_z)
    if min(now) <= 0:
        raise ValueError("spacings are positive")
    target = target_spacing if target_spacing > 0 else min(now)
    return scale(src, *(c / target for c in now), True, interpolate, True)


def make_anisotropic(src: Grid, current_spacing: float = -1.0, target_spacing_x: float = -1.0, target_spacing_y: float = -1.0, target_spacing_z: float = -1.0, interpolate: bool = True) -> Grid:
    """Rescales from one spacing to three."""
    target = (target_spacing_x, target_spacing_y, target_spacing_z)
    if min(target) <= 0:
        raise ValueError("spacings are positive")
    now = current_spacing if current_spacing > 0 else min(target)
    return scale(src, *(now / c for c in target), True, interpolate, True)
