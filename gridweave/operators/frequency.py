"""Frequency domain: a whole image is one group, transformed by numpy.

A Fourier transform needs all voxels of an image, so an image has to fit a
worker; many images are many groups.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.grid import FLOAT, Grid


def smooth_size(n: int) -> int:
    """The next size whose prime factors are 2, 3, 5 and 7."""
    while True:
        m = n
        for p in (2, 3, 5, 7):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def fft_smooth_shape(shape: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(smooth_size(n) if n > 1 else 1 for n in shape)


def fft_pad_shape(shape: tuple[int, int, int], kernel: tuple[int, int, int]) -> tuple[int, int, int]:
    return tuple(n + 2 * (k // 2) for n, k in zip(shape, kernel, strict=True))


def _rows(a: np.ndarray) -> pd.DataFrame:
    z, y, x = np.indices(a.shape).reshape(3, -1).astype(np.int32)
    return pd.DataFrame({"z": z, "y": y, "x": x, "v": a.ravel().astype(float)})


def _whole(src: Grid, fn: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    w, h, d = src.shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((d, h, w))
        a[pdf["z"], pdf["y"], pdf["x"]] = pdf["v"]
        return fn(a)

    return src.df.groupBy(F.lit(0).alias("img")).applyInPandas(run, schema)


def fft(src: Grid) -> DataFrame:
    """(z, y, x, re, im): the real-to-complex transform, width / 2 + 1 wide."""

    def fn(a: np.ndarray) -> pd.DataFrame:
        f = np.fft.rfftn(a)
        return _rows(f.real).rename(columns={"v": "re"}).assign(im=f.imag.ravel())

    return _whole(src, fn, "z int, y int, x int, re double, im double")


def ifft(spectrum: DataFrame, shape: tuple[int, int, int]) -> Grid:
    """The real grid of a spectrum of ``fft``."""
    w, h, d = shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.zeros((d, h, w // 2 + 1), complex)
        f[pdf["z"], pdf["y"], pdf["x"]] = pdf["re"] + 1j * pdf["im"]
        return _rows(np.fft.irfftn(f, (d, h, w)))

    return Grid(spectrum.groupBy(F.lit(0).alias("img")).applyInPandas(run, "z int, y int, x int, v double"), shape, FLOAT)


def _placed(a: np.ndarray, size: tuple[int, ...]) -> tuple[np.ndarray, tuple[slice, ...]]:
    """An array in the middle of a larger one of zeros, the odd voxel before it; and where it lies."""
    inner = tuple(slice(-(-(m - n) // 2), -(-(m - n) // 2) + n) for n, m in zip(a.shape, size, strict=True))
    out = np.zeros(size)
    out[inner] = a
    return out, inner


def _volume(kernel: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """A kernel with three axes, no longer than the grid's."""
    k = np.asarray(kernel, float)
    k = k.reshape((1,) * (3 - k.ndim) + k.shape)
    if any(n > m for n, m in zip(k.shape, shape[::-1], strict=True)):
        raise ValueError(f"a kernel of {k.shape[::-1]} is larger than a grid of {shape}")
    return k


def convolve_fft(src: Grid, kernel: np.ndarray, correlate: bool = False) -> Grid:
    """Circular convolution, or correlation, of a grid padded with 0 to smooth extents.

    The kernel lies in the middle of the padded extent ``n`` and is moved back
    by ``ceil(n / 2) - 1`` (fixed rule): a kernel's middle is its origin where
    ``n`` is odd, its first voxel where ``n`` is even and the kernel's is odd.
    """
    k3 = _volume(kernel, src.shape)

    def fn(a: np.ndarray) -> pd.DataFrame:
        size = tuple(map(smooth_size, a.shape))
        seen, inner = _placed(a, size)
        f = np.fft.rfftn(np.roll(_placed(k3, size)[0], [1 - -(-n // 2) for n in size], (0, 1, 2)))
        out = np.fft.irfftn(np.fft.rfftn(seen) * (np.conj(f) if correlate else f), size)
        return _rows(out[inner])

    return Grid(_whole(src, fn, "z int, y int, x int, v double"), src.shape, src.dtype).map(F.col("v"))


def _total_variation(a: np.ndarray, weight: float) -> np.ndarray:
    grads = [np.gradient(a, axis=i) if n > 1 else np.zeros_like(a) for i, n in enumerate(a.shape)]
    size = np.sqrt(sum(g * g for g in grads)) + 1e-8
    div = sum(np.gradient(g / size, axis=i) if a.shape[i] > 1 else 0 for i, g in enumerate(grads))
    return 1 / np.maximum(1 - weight * div, 1e-8)


def deconvolve_fft(src: Grid, psf: np.ndarray, normalization: np.ndarray | None = None, iteration: int = 100, regularization: float = 0.0) -> Grid:
    """Richardson-Lucy deconvolution, with an optional total-variation term and normalisation.

    Grid, kernel and normalisation lie in the middle of smooth extents; the
    kernel is moved on by ``n // 2 - 1`` (fixed rule), and the estimate starts
    at 1.
    """
    k3 = _volume(psf, src.shape)

    def fn(a: np.ndarray) -> pd.DataFrame:
        size = tuple(map(smooth_size, a.shape))
        seen, inner = _placed(a, size)
        f = np.fft.rfftn(np.roll(_placed(k3, size)[0], [n // 2 - 1 for n in size], (0, 1, 2)))
        norm = np.ones(size) if normalization is None else _placed(np.asarray(normalization, float).reshape(a.shape), size)[0]
        out = np.ones(size)
        for _ in range(iteration):
            blurred = np.fft.irfftn(np.fft.rfftn(out) * f, size)
            ratio = np.divide(seen, blurred, out=np.zeros(size), where=np.abs(blurred) > 1e-12)
            out = out * np.fft.irfftn(np.fft.rfftn(ratio) * np.conj(f), size) / np.where(norm > 0, norm, 1)
            if regularization > 0:
                out = out * _total_variation(out, regularization)
        return _rows(out[inner])

    return Grid(_whole(src, fn, "z int, y int, x int, v double"), src.shape, FLOAT)


__all__ = ["convolve_fft", "deconvolve_fft", "fft", "fft_pad_shape", "fft_smooth_shape", "ifft", "smooth_size"]
