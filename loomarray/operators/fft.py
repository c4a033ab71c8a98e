"""Discrete Fourier transforms: lines in NumPy, spread over the cluster; long single lines by four steps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from loomarray import dtypes as dt
from loomarray.cells import Array, asarray, axes_of, coords, generated, mapped
from loomarray.operators.dense import along
from loomarray.operators.shape import array_split, moveaxis, pad, roll

#: A single line of more cells is cut into a matrix whose rows and columns are transformed in turn.
LONG = 1 << 20


def _complex(a) -> Array:
    a = asarray(a)
    return a.astype(np.complex64 if a.dtype.name in ("float16", "float32", "complex64") else np.complex128)


def _sized(a: Array, n: int | None, axis: int) -> Array:
    have = a.shape[axis]
    if n is None or n == have:
        return a
    if n < 1:
        raise ValueError(f"Invalid number of FFT data points ({n}) specified.")
    return array_split(a, [n], axis)[0] if n < have else pad(a, [(0, n - have) if k == axis else (0, 0) for k in range(a.ndim)])


def _one(name: str, a: Array, n, axis: int, norm, length, dtype) -> Array:
    (k,) = axes_of(axis, a.ndim)
    f = getattr(np.fft, name)
    return along(a, k, lambda v: f(v, n, norm=norm), length, dtype)


def _plain(a, n, axis, norm, inverse: bool) -> Array:
    a = _complex(a)
    (k,) = axes_of(axis, a.ndim)
    a = _sized(a, n, k)
    size = a.shape[k]
    if a.ndim == 1 and size > LONG:
        out = four_step(a, inverse)
        if out is not None:
            scale = {"ortho": 1 / math.sqrt(size), "forward": 1.0 if inverse else 1 / size}.get(norm, 1 / size if inverse else 1.0)
            return out if scale == 1.0 else mapped(lambda v: dt.cplx(v["re"] * scale, v["im"] * scale, a.dtype), a.dtype, out)
    return _one("ifft" if inverse else "fft", a, None, k, norm, size, a.dtype)


def four_step(a: Array, inverse: bool = False) -> Array | None:
    """A long line as a matrix: transforms of columns, a turn of each cell, transforms of rows (None for a prime length)."""
    n = a.size
    p = next((d for d in range(int(math.isqrt(n)), 1, -1) if n % d == 0), None)
    if p is None:
        return None
    q = n // p
    name, sign = ("ifft", 1.0) if inverse else ("fft", -1.0)
    m = a.reshaped((p, q))
    columns = _one(name, m, None, 0, "forward" if inverse else None, p, a.dtype)
    angle = sign * 2 * math.pi / n
    grid = generated((p, q), np.float64, lambda i: (coords(i, (p, q))[0] * coords(i, (p, q))[1]).cast("double") * angle)

    def turn(v, t):
        re, im, c, s = v["re"].cast("double"), v["im"].cast("double"), F.cos(t), F.sin(t)
        return dt.cplx(re * c - im * s, re * s + im * c, a.dtype)

    rows = _one(name, mapped(turn, a.dtype, columns, grid), None, 1, "forward" if inverse else None, q, a.dtype)
    from loomarray.operators.shape import transpose

    return transpose(rows).reshaped((n,))


def fft(a, n=None, axis: int = -1, norm=None) -> Array:
    return _plain(a, n, axis, norm, False)


def ifft(a, n=None, axis: int = -1, norm=None) -> Array:
    return _plain(a, n, axis, norm, True)


def _real(a) -> Array:
    a = asarray(a)
    if a.dtype.kind == "c":
        raise TypeError("real input only")
    return a.astype(np.float32) if a.dtype.name in ("float16", "float32") else a.astype(np.float64)


def rfft(a, n=None, axis: int = -1, norm=None) -> Array:
    a = _real(a)
    (k,) = axes_of(axis, a.ndim)
    a = _sized(a, n, k)
    return _one("rfft", a, None, k, norm, a.shape[k] // 2 + 1, np.result_type(a.dtype, np.complex64))


def irfft(a, n=None, axis: int = -1, norm=None) -> Array:
    a = _complex(a)
    (k,) = axes_of(axis, a.ndim)
    n = 2 * (a.shape[k] - 1) if n is None else n
    return _one("irfft", a, n, k, norm, n, dt.part(a.dtype))


def hfft(a, n=None, axis: int = -1, norm=None) -> Array:
    a = _complex(a)
    (k,) = axes_of(axis, a.ndim)
    n = 2 * (a.shape[k] - 1) if n is None else n
    return _one("hfft", a, n, k, norm, n, dt.part(a.dtype))


def ihfft(a, n=None, axis: int = -1, norm=None) -> Array:
    a = _real(a)
    (k,) = axes_of(axis, a.ndim)
    a = _sized(a, n, k)
    return _one("ihfft", a, None, k, norm, a.shape[k] // 2 + 1, np.result_type(a.dtype, np.complex64))


def _axes(a: Array, s, axes) -> tuple[list[int], list]:
    if axes is None:
        axes = list(range(a.ndim)) if s is None else list(range(a.ndim - len(s), a.ndim))
    axes = axes_of(axes, a.ndim)
    return axes, [None] * len(axes) if s is None else list(s)


def fftn(a, s=None, axes=None, norm=None) -> Array:
    a = asarray(a)
    axes, s = _axes(a, s, axes)
    for k, n in zip(reversed(axes), reversed(s), strict=True):
        a = fft(a, n, k, norm)
    return a


def ifftn(a, s=None, axes=None, norm=None) -> Array:
    a = asarray(a)
    axes, s = _axes(a, s, axes)
    for k, n in zip(reversed(axes), reversed(s), strict=True):
        a = ifft(a, n, k, norm)
    return a


def rfftn(a, s=None, axes=None, norm=None) -> Array:
    a = asarray(a)
    axes, s = _axes(a, s, axes)
    a = rfft(a, s[-1], axes[-1], norm)
    for k, n in zip(axes[:-1], s[:-1], strict=True):
        a = fft(a, n, k, norm)
    return a


def irfftn(a, s=None, axes=None, norm=None) -> Array:
    a = asarray(a)
    axes, s = _axes(a, s, axes)
    for k, n in zip(axes[:-1], s[:-1], strict=True):
        a = ifft(a, n, k, norm)
    return irfft(a, s[-1], axes[-1], norm)


def fft2(a, s=None, axes=(-2, -1), norm=None) -> Array:
    return fftn(a, s, axes, norm)


def ifft2(a, s=None, axes=(-2, -1), norm=None) -> Array:
    return ifftn(a, s, axes, norm)


def rfft2(a, s=None, axes=(-2, -1), norm=None) -> Array:
    return rfftn(a, s, axes, norm)


def irfft2(a, s=None, axes=(-2, -1), norm=None) -> Array:
    return irfftn(a, s, axes, norm)


def fftfreq(n: int, d: float = 1.0) -> Array:
    return generated((n,), np.float64, lambda i: F.when(i <= (n - 1) // 2, i).otherwise(i - n).cast("double") / (n * d))


def rfftfreq(n: int, d: float = 1.0) -> Array:
    return generated((n // 2 + 1,), np.float64, lambda i: i.cast("double") / (n * d))


def fftshift(a, axes=None) -> Array:
    a = asarray(a)
    axes = axes_of(axes, a.ndim)
    return roll(a, [a.shape[k] // 2 for k in axes], axes)


def ifftshift(a, axes=None) -> Array:
    a = asarray(a)
    axes = axes_of(axes, a.ndim)
    return roll(a, [-(a.shape[k] // 2) for k in axes], axes)


del moveaxis
