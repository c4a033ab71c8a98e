"""Constructors: values are functions of the flat index, so nothing is stored until it is used."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from loomarray import dtypes as dt
from loomarray.cells import Array, asarray, coords, generated, local, mapped


def _shape(shape) -> tuple[int, ...]:
    return (int(shape),) if np.isscalar(shape) else tuple(int(s) for s in shape)


def full(shape, fill_value, dtype=None) -> Array:
    d = dt.dtype(np.asarray(fill_value).dtype if dtype is None else dtype)
    return generated(_shape(shape), d, lambda i: dt.lit(fill_value, d))


def zeros(shape, dtype=np.float64) -> Array:
    return full(shape, 0, dtype)


def ones(shape, dtype=np.float64) -> Array:
    return full(shape, 1, dtype)


empty = zeros


def full_like(a, fill_value, dtype=None) -> Array:
    a = asarray(a)
    return full(a.shape, fill_value, a.dtype if dtype is None else dtype)


def zeros_like(a, dtype=None) -> Array:
    return full_like(a, 0, dtype)


def ones_like(a, dtype=None) -> Array:
    return full_like(a, 1, dtype)


empty_like = zeros_like


def array(data, dtype=None) -> Array:
    return asarray(data, dtype)


def copy(a) -> Array:
    """Arrays never change, so a copy is the array."""
    return asarray(a)


asanyarray = asarray


def ascontiguousarray(a, dtype=None) -> Array:
    a = asarray(a, dtype)
    return a if a.ndim else a.reshaped((1,))


asfortranarray = ascontiguousarray


def asarray_chkfinite(a, dtype=None) -> Array:
    from loomarray.cells import elementwise
    from loomarray.operators.reductions import all as all_

    a = asarray(a, dtype)
    if a.dtype.kind in "fc" and not all_(elementwise("isfinite", a)).item():
        raise ValueError("array must not contain infs or NaNs")
    return a


def require(a, dtype=None, requirements=None) -> Array:
    return asarray(a, dtype)


def arange(start, stop=None, step=1, dtype=None) -> Array:
    if stop is None:
        start, stop = 0, start
    d = dt.dtype(np.result_type(*(type(x) if isinstance(x, (int, float)) else x for x in (start, stop, step))) if dtype is None else dtype)
    n = max(0, math.ceil((stop - start) / step))
    kind = np.dtype("int64") if all(isinstance(x, int) for x in (start, step)) else np.dtype("float64")
    t = dt.spark_type(kind)
    return generated((n,), d, lambda i: dt.cast(F.lit(start).cast(t) + i * F.lit(step).cast(t), kind, d))


def linspace(start, stop, num: int = 50, endpoint: bool = True, dtype=np.float64) -> Array:
    d = dt.dtype(dtype)
    gaps = num - 1 if endpoint else num
    step = (stop - start) / gaps if gaps > 0 else 0.0

    def f(i):
        v = F.lit(float(start)) + i.cast("double") * float(step)
        v = F.when(i == num - 1, F.lit(float(stop))).otherwise(v) if endpoint and num > 1 else v
        return dt.cast(F.floor(v).cast("double") if d.kind in "iu" else v, np.dtype("float64"), d)

    return generated((num,), d, f)


def logspace(start, stop, num: int = 50, endpoint: bool = True, base: float = 10.0, dtype=np.float64) -> Array:
    d = dt.dtype(dtype)
    return linspace(start, stop, num, endpoint).with_value(lambda v: dt.cast(F.pow(F.lit(float(base)), v), np.dtype("float64"), d), d)


def geomspace(start, stop, num: int = 50, endpoint: bool = True, dtype=np.float64) -> Array:
    d = dt.dtype(dtype)
    if start * stop <= 0:
        raise ValueError("Geometric sequence cannot include zero")
    sign = -1.0 if start < 0 else 1.0
    logs = linspace(math.log10(abs(start)), math.log10(abs(stop)), num, endpoint)

    def f(i):
        v = F.pow(F.lit(10.0), logs.gen(i)) * sign
        v = F.when(i == 0, float(start)).otherwise(v)
        v = F.when(i == num - 1, float(stop)).otherwise(v) if endpoint and num > 1 else v
        return dt.cast(v, np.dtype("float64"), d)

    return generated((num,), d, f)


def eye(n: int, m: int | None = None, k: int = 0, dtype=np.float64) -> Array:
    m, d = n if m is None else m, dt.dtype(dtype)

    def f(i):
        r, c = coords(i, (n, m))
        return F.when(c - r == k, dt.lit(1, d)).otherwise(dt.lit(0, d))

    return generated((n, m), d, f)


def identity(n: int, dtype=np.float64) -> Array:
    return eye(n, dtype=dtype)


def tri(n: int, m: int | None = None, k: int = 0, dtype=np.float64) -> Array:
    m, d = n if m is None else m, dt.dtype(dtype)

    def f(i):
        r, c = coords(i, (n, m))
        return F.when(c - r <= k, dt.lit(1, d)).otherwise(dt.lit(0, d))

    return generated((n, m), d, f)


def _half(a, keep) -> Array:
    a = asarray(a)
    if a.ndim == 1:
        from loomarray.operators.shape import broadcast_to

        a = broadcast_to(a, (a.size, a.size))
    mask = generated(a.shape, np.bool_, lambda i: keep(*coords(i, a.shape)[-2:]))
    return mapped(lambda v, m: F.when(m, v).otherwise(dt.lit(0, a.dtype)), a.dtype, a, mask)


def tril(a, k: int = 0) -> Array:
    return _half(a, lambda r, c: c - r <= k)


def triu(a, k: int = 0) -> Array:
    return _half(a, lambda r, c: c - r >= k)


def diagflat(a, k: int = 0) -> Array:
    """A square matrix with the cells on its k-th diagonal."""
    from loomarray.cells import gather

    a = asarray(a)
    n = a.size + abs(k)

    def source(i):
        r, c = coords(i, (n, n))
        return F.when(c - r == k, r - max(0, -k))

    return gather(a.reshaped((a.size,)), (n, n), source, fill=0)


def diag(a, k: int = 0) -> Array:
    from loomarray.operators.linalg import diagonal

    a = asarray(a)
    return diagflat(a, k) if a.ndim == 1 else diagonal(a, k)


def vander(x, n: int | None = None, increasing: bool = False) -> Array:
    from loomarray.cells import elementwise

    x = asarray(x)
    n = x.size if n is None else n
    power = generated((1, n), np.int64, lambda i: i if increasing else F.lit(n - 1) - i)
    d = np.promote_types(x.dtype, int)
    return elementwise("power", x.reshaped((x.size, 1)).astype(d), power.astype(d) if d.kind in "iu" else power).astype(d)


def frombuffer(buffer, dtype=np.float64, count: int = -1, offset: int = 0) -> Array:
    return local(np.frombuffer(buffer, dtype, count, offset).copy())


def fromfunction(f, shape, dtype=np.float64) -> Array:
    """`f` of the coordinate arrays; built of array functions it stays a function of the index."""
    shape = _shape(shape)
    grids = [generated(shape, np.int64, lambda i, k=k: coords(i, shape)[k]).astype(dtype) for k in range(len(shape))]
    out = f(*grids)
    return out if isinstance(out, Array) else full(shape, out)


def fromiter(iterable, dtype, count: int = -1) -> Array:
    return local(np.fromiter(iterable, dtype, count))


def fromstring(text: str, dtype=np.float64, count: int = -1, sep: str = " ") -> Array:
    return local(np.fromstring(text, dtype, count, sep=sep))


def fromfile(path: str, dtype=np.float64, count: int = -1, sep: str = "", offset: int = 0) -> Array:
    """Raw values of a file, read in blocks on the executors, or text with a separator, split there.

    `offset` counts bytes and `count` values; a file that ends within a value raises.
    """
    from loomarray.sources.npy import blocks_of, store

    d = dt.dtype(dtype)
    if sep:
        from loomarray.sources.text import separated

        return separated(path, d, count, sep)
    system, p = store(path)
    info = system.get_file_info(p)
    if not info.is_file:
        raise FileNotFoundError(f"not a file: {path}")
    n = max(0, (info.size - offset) // d.itemsize)
    return blocks_of(path, d, offset, (n if count < 0 else min(n, count),))


def meshgrid(*xi, indexing: str = "xy", sparse: bool = False) -> list[Array]:
    from loomarray.operators.shape import broadcast_to

    arrays = [asarray(x) for x in xi]
    n = len(arrays)
    order = list(range(n))
    if indexing == "xy" and n > 1:
        order[0], order[1] = 1, 0
    shape = tuple(arrays[k].size for k in order)
    out = []
    for k, a in enumerate(arrays):
        at = order.index(k)
        thin = a.reshaped(tuple(a.size if j == at else 1 for j in range(n)))
        out.append(thin if sparse else broadcast_to(thin, shape))
    return out
