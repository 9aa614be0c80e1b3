"""Tiled stencils: blocks with a halo, one numpy call for each.

A voxel is sent to each tile whose halo holds it, so there is one shuffle and
only voxels near tile borders travel twice.  A tile's size bounds what a task
holds, whatever the size of the grid.  Outside the grid the edge is repeated,
or there is one value.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridweave.grid import AXES, FLOAT, Grid

#: Extents of a tile along x, y and z.
TILE = (64, 64, 16)


def stencil(src: Grid, radius: tuple[int, int, int], fn: Callable[[np.ndarray], np.ndarray], dtype: str | None = None, tile: tuple[int, int, int] = TILE, outside: float | None = None) -> Grid:
    """``fn`` gets a block [z, y, x] with ``radius`` more voxels at each end and returns the inner block."""
    r = tuple(min(k, n) if n > 1 else 0 for k, n in zip(radius, src.shape, strict=True))
    t = tuple(min(a, n) for a, n in zip(tile, src.shape, strict=True))
    rows = src.df
    for axis, n, k, a in zip(AXES, src.shape, r, t, strict=True):
        c, last = F.col(axis), (n - 1) // a
        if k:
            first = F.greatest(F.lit(0), F.floor((c - k) / a)).cast("int")
            end = F.least(F.lit(last), F.floor((c + k) / a)).cast("int")
            rows = rows.withColumn(f"t{axis}", F.explode(F.sequence(first, end)))
        else:
            rows = rows.withColumn(f"t{axis}", F.floor(c / a).cast("int"))
    shape, full = src.shape[::-1], radius[::-1]

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = [key[2], key[1], key[0]]  # z, y, x
        begin = [i * a for i, a in zip(at, t[::-1], strict=True)]
        end = [min(b + a, n) for b, a, n in zip(begin, t[::-1], shape, strict=True)]
        lo = [max(0, b - k) for b, k in zip(begin, r[::-1], strict=True)]
        hi = [min(n, e + k) for e, k, n in zip(end, r[::-1], shape, strict=True)]
        box = np.zeros([h - b for b, h in zip(lo, hi, strict=True)])
        box[pdf["z"].to_numpy() - lo[0], pdf["y"].to_numpy() - lo[1], pdf["x"].to_numpy() - lo[2]] = pdf["v"].to_numpy()
        widths = [(k - (b - o), k - (h - e)) if n > 1 else (0, 0) for k, b, e, o, h, n in zip(full, begin, end, lo, hi, shape, strict=True)]
        out = fn(np.pad(box, widths, mode="edge") if outside is None else np.pad(box, widths, constant_values=outside))
        z, y, x = np.indices(out.shape).reshape(3, -1)
        return pd.DataFrame({"z": (z + begin[0]).astype(np.int32), "y": (y + begin[1]).astype(np.int32), "x": (x + begin[2]).astype(np.int32), "v": out.ravel().astype(float)})

    got = rows.groupBy("tx", "ty", "tz").applyInPandas(block, "z int, y int, x int, v double")
    return Grid(got, src.shape, src.dtype).map(F.col("v"), dtype or src.dtype)


def shifts(block: np.ndarray, radius: tuple[int, int, int], offsets: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """The inner block, moved by each offset (dz, dy, dx); ``radius`` is (x, y, z)."""
    rx, ry, rz = radius
    d, h, w = block.shape[0] - 2 * rz, block.shape[1] - 2 * ry, block.shape[2] - 2 * rx
    return [block[rz + a : rz + a + d, ry + b : ry + b + h, rx + c : rx + c + w] for a, b, c in offsets]


def sphere(radius: tuple[float, float, float], shape: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """Offsets (dz, dy, dx) inside an ellipsoid; axes of extent 1 are left out."""
    r = [int(k) if n > 1 else 0 for k, n in zip(radius, shape, strict=True)]
    out = []
    for dz in range(-r[2], r[2] + 1):
        for dy in range(-r[1], r[1] + 1):
            for dx in range(-r[0], r[0] + 1):
                if sum((o / k) ** 2 for o, k in ((dx, r[0]), (dy, r[1]), (dz, r[2])) if k) <= 1:
                    out.append((dz, dy, dx))
    return out


def box(radius: tuple[float, float, float], shape: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    r = [int(k) if n > 1 else 0 for k, n in zip(radius, shape, strict=True)]
    return [(dz, dy, dx) for dz in range(-r[2], r[2] + 1) for dy in range(-r[1], r[1] + 1) for dx in range(-r[0], r[0] + 1)]


def over_offsets(src: Grid, offsets: list[tuple[int, int, int]], fn: Callable[[np.ndarray], np.ndarray], dtype: str | None = None) -> Grid:
    """``fn`` reduces the stack of the neighbours at ``offsets`` along its first axis."""
    radius = tuple(max([0, *(abs(o[i]) for o in offsets)]) for i in (2, 1, 0))
    radius = tuple(k if n > 1 else 0 for k, n in zip(radius, src.shape, strict=True))
    flat = [tuple(c if n > 1 else 0 for c, n in zip(o, src.shape[::-1], strict=True)) for o in offsets]
    return stencil(src, radius, lambda b: fn(np.stack(shifts(b, radius, flat))), dtype)
