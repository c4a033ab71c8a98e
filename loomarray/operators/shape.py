"""Shapes: index arithmetic on the flat index; only what repeats cells makes rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import functions as F

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, asarray, axes_of, coords, gather, generated, mapped, moved, ravel, size_of, stretched


def reshape(a, shape) -> Array:
    a = asarray(a)
    shape = [shape] if np.isscalar(shape) else list(shape)
    if shape.count(-1) > 1:
        raise ValueError("can only specify one unknown dimension")
    if -1 in shape:
        rest = math.prod(s for s in shape if s != -1)
        if not rest or a.size % rest:
            raise ValueError(f"cannot reshape array of size {a.size} into shape {tuple(shape)}")
        shape[shape.index(-1)] = a.size // rest
    if size_of(shape) != a.size:
        raise ValueError(f"cannot reshape array of size {a.size} into shape {tuple(shape)}")
    return a.reshaped(shape)


def ravel_(a) -> Array:
    a = asarray(a)
    return a.reshaped((a.size,))


flatten = ravel_


def squeeze(a, axis=None) -> Array:
    a = asarray(a)
    axes = [k for k, d in enumerate(a.shape) if d == 1] if axis is None else axes_of(axis, a.ndim)
    if any(a.shape[k] != 1 for k in axes):
        raise ValueError("cannot select an axis to squeeze out which has size not equal to one")
    return a.reshaped([d for k, d in enumerate(a.shape) if k not in axes])


def expand_dims(a, axis) -> Array:
    a = asarray(a)
    n = a.ndim + (1 if np.isscalar(axis) else len(axis))
    axes, rest = axes_of(axis, n), iter(a.shape)
    return a.reshaped([1 if k in axes else next(rest) for k in range(n)])


def transpose(a, axes=None) -> Array:
    a = asarray(a)
    axes = list(range(a.ndim))[::-1] if axes is None else axes_of(axes, a.ndim)
    if len(axes) != a.ndim:
        raise ValueError("axes don't match array")
    return moved(a, [a.shape[k] for k in axes], lambda c: [c[k] for k in axes])


permute_dims = transpose


def matrix_transpose(a) -> Array:
    a = asarray(a)
    return swapaxes(a, -1, -2)


def swapaxes(a, x: int, y: int) -> Array:
    a = asarray(a)
    order = list(range(a.ndim))
    x, y = axes_of([x, y], a.ndim) if x % a.ndim != y % a.ndim else (x, x)
    order[x], order[y] = order[y], order[x]
    return transpose(a, order)


def moveaxis(a, source, destination) -> Array:
    a = asarray(a)
    s, d = axes_of(source, a.ndim), axes_of(destination, a.ndim)
    order = [k for k in range(a.ndim) if k not in s]
    for to, of in sorted(zip(d, s, strict=True)):
        order.insert(to, of)
    return transpose(a, order)


def rollaxis(a, axis: int, start: int = 0) -> Array:
    a = asarray(a)
    (k,) = axes_of(axis, a.ndim)
    start = start + a.ndim if start < 0 else start
    order = [j for j in range(a.ndim) if j != k]
    order.insert(start - (start > k), k)
    return transpose(a, order)


def concatenate(arrays: Sequence, axis=0, dtype=None) -> Array:
    """Cells of the operands, each moved along the axis."""
    arrays = [asarray(a) for a in arrays]
    if axis is None:
        arrays, axis = [ravel_(a) for a in arrays], 0
    if not arrays[0].ndim:
        raise ValueError("zero-dimensional arrays cannot be concatenated")
    (k,) = axes_of(axis, arrays[0].ndim)
    first = arrays[0].shape
    if any(a.ndim != len(first) or any(x != y for j, (x, y) in enumerate(zip(a.shape, first, strict=False)) if j != k) for a in arrays):
        raise ValueError("all the input array dimensions except for the concatenation axis must match exactly")
    d = np.result_type(*(a.dtype for a in arrays)) if dtype is None else np.dtype(dtype)
    total = int(np.sum([a.shape[k] for a in arrays]))
    shape = (*first[:k], total, *first[k + 1 :])
    at, out = 0, None
    for a in arrays:
        x = a.astype(d)
        cs = coords(F.col(I), a.shape)
        cs[k] = cs[k] + at
        df = x.df.select(ravel(cs, shape).alias(I), V)
        out = df if out is None else out.union(df)
        at += a.shape[k]
    return Array.of(out, shape, d)


concat = concatenate


def stack(arrays: Sequence, axis: int = 0) -> Array:
    arrays = [asarray(a) for a in arrays]
    if len({a.shape for a in arrays}) > 1:
        raise ValueError("all input arrays must have the same shape")
    (k,) = axes_of(axis, arrays[0].ndim + 1)
    return concatenate([expand_dims(a, k) for a in arrays], k)


def atleast_1d(*arrays):
    out = [a if a.ndim else a.reshaped((1,)) for a in map(asarray, arrays)]
    return out[0] if len(out) == 1 else out


def atleast_2d(*arrays):
    out = [a if a.ndim > 1 else a.reshaped((1, a.size)) for a in map(asarray, arrays)]
    return out[0] if len(out) == 1 else out


def atleast_3d(*arrays):
    out = [a if a.ndim > 2 else a.reshaped((1, a.size, 1)) if a.ndim < 2 else a.reshaped((*a.shape, 1)) for a in map(asarray, arrays)]
    return out[0] if len(out) == 1 else out


def vstack(arrays: Sequence) -> Array:
    return concatenate([atleast_2d(a) for a in arrays], 0)


row_stack = vstack


def hstack(arrays: Sequence) -> Array:
    arrays = [atleast_1d(a) for a in arrays]
    return concatenate(arrays, 0 if arrays[0].ndim == 1 else 1)


def dstack(arrays: Sequence) -> Array:
    return concatenate([atleast_3d(a) for a in arrays], 2)


def column_stack(arrays: Sequence) -> Array:
    return concatenate([a if a.ndim > 1 else a.reshaped((a.size, 1)) for a in map(asarray, arrays)], 1)


def block(parts) -> Array:
    """Nested lists of blocks: the innermost lists join along the last axis, the next along the one before."""

    def depth(x):
        return 1 + depth(x[0]) if isinstance(x, list) else 0

    n = depth(parts)

    def widest(x):
        return max(map(widest, x)) if isinstance(x, list) else asarray(x).ndim

    dims = max(n, widest(parts))

    def build(x, level):
        if not isinstance(x, list):
            a = asarray(x)
            return a.reshaped((1,) * (dims - a.ndim) + a.shape)
        return concatenate([build(y, level + 1) for y in x], dims - n + level)

    return build(parts, 0)


def array_split(a, sections, axis: int = 0) -> list[Array]:
    a = asarray(a)
    (k,) = axes_of(axis, a.ndim)
    n = a.shape[k]
    if np.isscalar(sections):
        each, extra = divmod(n, int(sections))
        cuts = np.cumsum([0] + [each + 1] * extra + [each] * (int(sections) - extra)).tolist()
    else:
        cuts = [0, *(c + n if c < 0 else min(c, n) for c in sections), n]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        hi = max(lo, hi)

        def shift(c, lo=lo):
            return [x - lo if j == k else x for j, x in enumerate(c)]

        out.append(moved(a, (*a.shape[:k], hi - lo, *a.shape[k + 1 :]), shift, lambda c, lo=lo, hi=hi: (c[k] >= lo) & (c[k] < hi)))
    return out


def split(a, sections, axis: int = 0) -> list[Array]:
    a = asarray(a)
    if np.isscalar(sections) and a.shape[axis] % sections:
        raise ValueError("array split does not result in an equal division")
    return array_split(a, sections, axis)


def vsplit(a, sections) -> list[Array]:
    return split(a, sections, 0)


def hsplit(a, sections) -> list[Array]:
    a = asarray(a)
    return split(a, sections, 0 if a.ndim == 1 else 1)


def dsplit(a, sections) -> list[Array]:
    return split(a, sections, 2)


def unstack(a, axis: int = 0) -> list[Array]:
    a = asarray(a)
    (k,) = axes_of(axis, a.ndim)
    return [squeeze(x, k) for x in array_split(a, a.shape[k], k)]


def tile(a, reps) -> Array:
    a = asarray(a)
    reps = [reps] if np.isscalar(reps) else list(reps)
    n = max(a.ndim, len(reps))
    own, reps = (1,) * (n - a.ndim) + a.shape, [1] * (n - len(reps)) + reps
    shape = [d * r for d, r in zip(own, reps, strict=True)]
    # each cell is repeated along new axes in front of the old ones
    wide = stretched(a.reshaped([x for d in own for x in (1, d)]), [x for d, r in zip(own, reps, strict=True) for x in (r, d)])
    out = Array.of(wide, shape, a.dtype)
    out._runs = a._runs * size_of(reps)
    return out


def repeat(a, repeats, axis=None) -> Array:
    a = asarray(a)
    if axis is None:
        a, axis = ravel_(a), 0
    (k,) = axes_of(axis, a.ndim)
    n = a.shape[k]
    times = np.broadcast_to(np.asarray(repeats), (n,)) if n else np.zeros(0, int)
    if np.isscalar(repeats):
        r = int(repeats)
        shape = (*a.shape[:k], n * r, *a.shape[k + 1 :])
        wide = stretched(a.reshaped((*a.shape[: k + 1], 1, *a.shape[k + 1 :])), (*a.shape[: k + 1], r, *a.shape[k + 1 :]))
        return Array.of(wide, shape, a.dtype)
    start = np.cumsum(times) - times
    shape = (*a.shape[:k], int(times.sum()), *a.shape[k + 1 :])
    cs = coords(F.col(I), a.shape)
    at, many = (F.get(F.array(*map(F.lit, map(int, x))), cs[k].cast("int")) for x in (start, times))
    df = a.df.where(many > 0).withColumn("_x", F.explode(F.sequence(at.cast("long"), (at + many - 1).cast("long"))))
    cs[k] = F.col("_x")
    return Array.of(df.select(ravel(cs, shape).alias(I), V), shape, a.dtype)


def flip(a, axis=None) -> Array:
    a = asarray(a)
    axes = axes_of(axis, a.ndim)
    return moved(a, a.shape, lambda c: [a.shape[k] - 1 - x if k in axes else x for k, x in enumerate(c)])


def fliplr(a) -> Array:
    return flip(a, 1)


def flipud(a) -> Array:
    return flip(a, 0)


def rot90(a, k: int = 1, axes=(0, 1)) -> Array:
    a = asarray(a)
    x, y = axes_of(axes, a.ndim)
    for _ in range(k % 4):
        a = flip(swapaxes(a, x, y), x)
    return a


def roll(a, shift, axis=None) -> Array:
    a = asarray(a)
    if axis is None:
        return roll(ravel_(a), shift, 0).reshaped(a.shape)
    axes = [axis] if np.isscalar(axis) else list(axis)
    by = dict.fromkeys(range(a.ndim), 0)
    for k, s in zip(axes, np.broadcast_to(shift, len(axes)).tolist(), strict=True):
        by[axes_of(k, a.ndim)[0]] += s
    return moved(a, a.shape, lambda c: [F.pmod(x + by[k], F.lit(max(1, a.shape[k]))) if by[k] else x for k, x in enumerate(c)])


def resize(a, shape) -> Array:
    """Cells over and over in order, to fill a shape."""
    a = asarray(a)
    shape = [shape] if np.isscalar(shape) else list(shape)
    n = size_of(shape)
    if not a.size:
        return generated(shape, a.dtype, lambda i: dt.lit(0, a.dtype))
    flat = ravel_(a)
    times = -(-n // a.size)
    out = tile(flat, times)
    return moved(out, (n,), lambda c: c, lambda c: c[0] < n).reshaped(shape)


def append(a, values, axis=None) -> Array:
    a, b = asarray(a), asarray(values)
    return concatenate([ravel_(a), ravel_(b)]) if axis is None else concatenate([a, b], axis)


def _places(obj, n: int) -> np.ndarray:
    if isinstance(obj, slice):
        return np.arange(n)[obj]
    at = np.atleast_1d(np.asarray(obj))
    if at.dtype.kind == "b":
        return np.flatnonzero(at)
    if ((at < -n) | (at >= n + 1)).any():
        raise IndexError("index out of bounds")
    return np.where(at < 0, at + n, at).astype(int)


def delete(a, obj, axis=None) -> Array:
    """Without the given places of an axis."""
    a = asarray(a)
    if axis is None:
        a, axis = ravel_(a), 0
    (k,) = axes_of(axis, a.ndim)
    gone = np.unique(_places(obj, a.shape[k]))
    array = F.array(*map(F.lit, gone.tolist())).cast("array<bigint>")
    shape = (*a.shape[:k], a.shape[k] - len(gone), *a.shape[k + 1 :])
    return moved(a, shape, lambda c: [x - F.size(F.filter(array, lambda g: g < x)) if j == k else x for j, x in enumerate(c)], lambda c: ~F.array_contains(array, c[k]))


delete_ = delete


def insert(a, obj, values, axis=None) -> Array:
    """With values put before the given places of an axis."""
    a = asarray(a)
    if axis is None:
        a, axis = ravel_(a), 0
    (k,) = axes_of(axis, a.ndim)
    n = a.shape[k]
    at = _places(obj, n)
    m = len(at)
    order = np.argsort(at, kind="stable")
    place = np.empty(m, int)
    place[order] = at[order] + np.arange(m)  # of the new ones in the result
    shape = (*a.shape[:k], n + m, *a.shape[k + 1 :])
    taken = F.array(*map(F.lit, np.sort(at).tolist())).cast("array<bigint>")
    old = moved(a, shape, lambda c: [x + F.size(F.filter(taken, lambda g: g <= x)) if j == k else x for j, x in enumerate(c)])
    v = asarray(np.asarray(values) if not isinstance(values, Array) else values).astype(a.dtype)
    if np.ndim(obj) == 0 and not isinstance(obj, slice) and v.ndim:
        v = moveaxis(v.reshaped((1,) * (a.ndim - v.ndim) + v.shape), 0, k)
    inner = (*a.shape[:k], m, *a.shape[k + 1 :])
    v = broadcast_to(v, inner)
    to = F.array(*map(F.lit, place.tolist()))
    new = moved(v, shape, lambda c: [F.get(to, x.cast("int")).cast("long") if j == k else x for j, x in enumerate(c)])
    return Array.of(old.df.union(new.df), shape, a.dtype)


def broadcast_to(a, shape) -> Array:
    a = asarray(a)
    shape = tuple([shape] if np.isscalar(shape) else shape)
    if np.broadcast_shapes(a.shape, shape) != shape:
        raise ValueError("operands could not be broadcast together")
    if a.shape == shape:
        return a
    if a.gen is not None:
        from loomarray.cells import broadcast_index

        return generated(shape, a.dtype, lambda i: a.gen(broadcast_index(i, shape, a.shape)))
    return Array.of(stretched(a, shape), shape, a.dtype)


def broadcast_arrays(*arrays) -> list[Array]:
    arrays = [asarray(a) for a in arrays]
    shape = np.broadcast_shapes(*(a.shape for a in arrays))
    return [broadcast_to(a, shape) for a in arrays]


def broadcast_shapes(*shapes) -> tuple[int, ...]:
    return np.broadcast_shapes(*shapes)


def _widths(pad_width, n: int) -> list[tuple[int, int]]:
    if isinstance(pad_width, dict):
        return [tuple(np.broadcast_to(pad_width.get(k, pad_width.get(k - n, 0)), 2).tolist()) for k in range(n)]
    return [tuple(x) for x in np.broadcast_to(np.asarray(pad_width), (n, 2)).tolist()]


def pad(a, pad_width, mode="constant", constant_values=0, stat_length=None, end_values=0, reflect_type: str = "even") -> Array:
    """Cells around an array, in NumPy's modes (constant, edge, empty, linear_ramp, maximum, mean, median, minimum,
    reflect, symmetric, wrap) or by a function of a padded line."""
    a = asarray(a)
    widths = _widths(pad_width, a.ndim)
    shape = [lo + d + hi for (lo, hi), d in zip(widths, a.shape, strict=True)]
    if callable(mode):
        return _pad_by(a, widths, shape, mode)
    if mode in ("constant", "empty"):
        fills = np.broadcast_to(np.asarray(constant_values if mode == "constant" else 0), (a.ndim, 2))
        for k, (lo, hi) in enumerate(widths):
            sides = [generated((*a.shape[:k], n, *a.shape[k + 1 :]), a.dtype, lambda i, x=x: dt.lit(x, a.dtype)) for n, x in zip((lo, hi), fills[k].tolist(), strict=True)]
            a = concatenate([s for s in (sides[0], a, sides[1]) if s.shape[k]], k)
        return a
    if mode in ("edge", "reflect", "symmetric", "wrap") and reflect_type == "even":
        own = a.shape

        def source(i):
            out = []
            for x, (lo, _), d in zip(coords(i, shape), widths, own, strict=True):
                x = x - lo
                if mode == "edge":
                    x = F.least(F.greatest(x, F.lit(0)), F.lit(d - 1))
                elif mode == "wrap":
                    x = F.pmod(x, F.lit(d))
                elif mode == "symmetric":
                    x = F.pmod(x, F.lit(2 * d))
                    x = F.when(x >= d, 2 * d - 1 - x).otherwise(x)
                elif d > 1:
                    x = F.pmod(x, F.lit(2 * d - 2))
                    x = F.when(x >= d, 2 * d - 2 - x).otherwise(x)
                else:
                    x = F.lit(0)
                out.append(x.cast("long"))
            return ravel(out, own)

        return gather(a, shape, source)
    from loomarray.operators import reductions as red
    from loomarray.operators.ufuncs import around

    for k, (lo, hi) in enumerate(widths):
        n = a.shape[k]
        sides = []
        for width, end in ((lo, 0), (hi, 1)):
            if not width:
                continue
            if mode == "linear_ramp":
                value = float(np.broadcast_to(np.asarray(end_values), (a.ndim, 2))[k][end])
                edge = array_split(a, [1, n - 1] if n > 1 else [1], k)[0 if not end else -1 if n > 1 else 0]
                step = generated(tuple(width if j == k else 1 for j in range(a.ndim)), np.float64, lambda i, w=width, e=end: ((F.lit(w) - i - (0 if not e else 0)) if not e else (i + 1)).cast("double") / w)
                ramp = mapped(lambda x, s, v=value: x.cast("double") + (F.lit(v) - x.cast("double")) * s, np.float64, edge, step)
                sides.append((end, (ramp if a.dtype.kind == "f" else ramp).astype(a.dtype)))
                continue
            length = n if stat_length is None else int(min(n, np.broadcast_to(np.asarray(stat_length), (a.ndim, 2))[k][end]))
            part = array_split(a, [length] if not end else [n - length], k)[0 if not end else 1]
            f = {"maximum": red.max, "minimum": red.min, "mean": red.mean, "median": red.median}[mode]
            stat = f(part, axis=k, keepdims=True)
            stat = (around(stat) if a.dtype.kind in "iu" and mode in ("mean", "median") else stat).astype(a.dtype)
            sides.append((end, broadcast_to(stat, tuple(width if j == k else d for j, d in enumerate(a.shape)))))
        a = concatenate([*(s for e, s in sides if not e), a, *(s for e, s in sides if e)], k)
    return a


def _pad_by(a: Array, widths, shape, mode) -> Array:
    from loomarray.operators.dense import blocks

    def run(x):
        return np.pad(x, widths, mode)

    (out,) = blocks(a, list(range(a.ndim)), run, [(tuple(shape), a.dtype)])
    return out


def ascontiguousarray(a, dtype=None) -> Array:
    return atleast_1d(asarray(a, dtype))
