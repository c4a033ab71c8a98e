"""Indexing, gathering and scattering: filters and index arithmetic for slices, joins for index arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, asarray, axes_of, coords, gather, generated, mapped, moved, ravel, size_of

I64 = np.dtype("int64")


def parse_slice(s: str):
    """'0:2', '-1', '::2', '...' or 'newaxis'."""
    s = s.strip()
    if s == "...":
        return Ellipsis
    if s == "newaxis":
        return None
    if ":" in s:
        parts = [int(p) if p.strip() else None for p in s.split(":")]
        return slice(*parts)
    return int(s)


def getitem(a: Array, item) -> Array:
    item = item if isinstance(item, tuple) else (item,)
    if len(item) == 1 and isinstance(item[0], (Array, np.ndarray)) and np.dtype(item[0].dtype).kind == "b":
        return bindex(a, item[0])
    used = sum(1 for x in item if x is not None and x is not Ellipsis)
    if used > a.ndim:
        raise IndexError("too many indices for array")
    if Ellipsis not in [x for x in item if not isinstance(x, (Array, np.ndarray, list))]:
        item = (*item, Ellipsis)
    at = next(k for k, x in enumerate(item) if x is Ellipsis)
    item = (*item[:at], *[slice(None)] * (a.ndim - used), *item[at + 1 :])
    if any(isinstance(x, (Array, np.ndarray, list)) for x in item):
        return vindex(a, *item)
    shape, keep, lead, k = [], [], [], 0
    for x in item:
        if x is None:
            shape.append(1)
            continue
        n = a.shape[k]
        if isinstance(x, slice):
            r = range(*x.indices(n))
            keep.append((k, r))
            shape.append(len(r))
        else:
            j = int(x)
            if not -n <= j < n:
                raise IndexError(f"index {j} is out of bounds for axis {k} with size {n}")
            keep.append((k, range(j % n, j % n + 1)))
            lead.append(k)
        k += 1
    inner = [len(r) for _, r in keep]
    if all(r == range(a.shape[k]) for k, r in keep):
        return a.reshaped(shape)

    def test(cs):
        out = F.lit(True)
        for k, r in keep:
            if r == range(a.shape[k]):
                continue
            if not len(r):
                return F.lit(False)
            lo, hi = min(r[0], r[-1]), max(r[0], r[-1])
            out = out & cs[k].between(lo, hi)
            if abs(r.step) != 1:
                out = out & ((cs[k] - r[0]) % abs(r.step) == 0)
        return out

    def target(cs):
        return [F.call_function("div", cs[k] - r.start, F.lit(r.step)) if r.step != 1 else cs[k] - r.start for k, r in keep]

    out = moved(a, inner, target, test)
    if (g := a._lookup) is not None:
        out._lookup, out._reach = lambda i: g(ravel([c * r.step + r.start for c, (_, r) in zip(coords(i, inner), keep, strict=True)], a.shape)), a._reach
    return out.reshaped(shape)


def _ints(x) -> Array:
    x = x if isinstance(x, Array) else asarray(np.asarray(x, np.int64))
    return x.astype(I64)


def _wrapped(v, n: int):
    """A place counted from the end where negative; out of bounds raises."""
    bad = (v < -n) | (v >= n)
    return F.when(bad, F.raise_error(F.lit("index is out of bounds")).cast("long")).otherwise(F.when(v < 0, v + n).otherwise(v))


def _mode(v, n: int, mode: str):
    return F.pmod(v, F.lit(n)) if mode == "wrap" else F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("long") if mode == "clip" else _wrapped(v, n)


def take(a, indices, axis=None, mode: str = "raise") -> Array:
    """Cells at places along an axis: a join on the place."""
    a, at = asarray(a), _ints(indices)
    if axis is None:
        a, axis = a.reshaped((a.size,)), 0
    (k,) = axes_of(axis, a.ndim)
    n = a.shape[k]
    shape = (*a.shape[:k], *at.shape, *a.shape[k + 1 :])
    flat = (*a.shape[:k], at.size, *a.shape[k + 1 :])
    places = at.df.select(F.col(I).alias("_q"), _mode(F.col(V), n, mode).alias("_x"))
    cs = coords(F.col(I), a.shape)
    own = a.df.withColumn("_y", cs[k])
    joined = own.join(places, F.col("_x") == F.col("_y"))
    cs = coords(F.col(I), a.shape)
    cs[k] = F.col("_q")
    return Array.of(joined.select(ravel(cs, flat).alias(I), V), shape, a.dtype)


def iindex(a, indices, axis: int = 0) -> Array:
    return take(a, indices, axis)


def bindex(a, mask, axis=None) -> Array:
    """Cells where a mask is true: of the whole array, of its first axes, or along one axis."""
    from loomarray.operators.sorting import compress, extract

    a, m = asarray(a), asarray(mask)
    if axis is not None:
        return compress(m, a, axis)
    if m.ndim == a.ndim:
        return extract(m, a)
    flat = a.reshaped((m.size, *a.shape[m.ndim :]))
    return compress(m.reshaped((m.size,)), flat, 0)


def vindex(a, *item) -> Array:
    """Index arrays (broadcast together) mixed with slices and whole numbers, placed as NumPy does."""
    a = asarray(a)
    item = list(item) + [slice(None)] * (a.ndim - len([x for x in item if x is not None]))
    arrays, spans, k, slots = [], [], 0, []
    for x in item:
        if x is None:
            spans.append(("new", 0, range(1)))
            slots.append("s")
            continue
        n = a.shape[k]
        if isinstance(x, slice):
            spans.append(("axis", k, range(*x.indices(n))))
            slots.append("s")
        elif isinstance(x, (Array, np.ndarray, list)) and np.asarray(x if not isinstance(x, Array) else 0).dtype.kind == "b" or (isinstance(x, Array) and x.dtype.kind == "b"):
            arrays.append((k, asarray(np.flatnonzero(np.asarray(x.numpy() if isinstance(x, Array) else x)).astype(np.int64))))
            slots.append("a")
        else:
            arrays.append((k, _ints(x)))
            slots.append("a")
        k += 1
    shape = np.broadcast_shapes(*(x.shape for _, x in arrays))
    where = [j for j, s in enumerate(slots) if s == "a"]
    together = where == list(range(where[0], where[-1] + 1))
    ahead = len([s for s in slots[: where[0]] if s == "s"]) if together else 0
    before, after = spans[:ahead], spans[ahead:]
    final = (*(len(r) for _, _, r in before), *shape, *(len(r) for _, _, r in after))
    # places of the index arrays, one row each
    from loomarray.operators.shape import broadcast_to

    packed = mapped(lambda *v: F.struct(*(c.alias(f"x{j}") for j, c in enumerate(v))), I64, *(broadcast_to(x, shape) for _, x in arrays))
    places = packed.df.select(F.col(I).alias("_q"), *(_wrapped(F.col(V)[f"x{j}"], a.shape[k]).alias(f"_x{j}") for j, (k, _) in enumerate(arrays)))
    own = a.df
    cs = coords(F.col(I), a.shape)
    for j, (k, _) in enumerate(arrays):
        own = own.withColumn(f"_y{j}", cs[k])
    test, moved_ = F.lit(True), {}
    for kind, k, r in spans:
        if kind == "axis":
            if not len(r):
                test = F.lit(False)
            else:
                test = test & cs[k].between(min(r[0], r[-1]), max(r[0], r[-1])) & ((cs[k] - r[0]) % abs(r.step) == 0)
                moved_[k] = F.call_function("div", cs[k] - r.start, F.lit(r.step))
    on = F.lit(True)
    for j in range(len(arrays)):
        on = on & (F.col(f"_x{j}") == F.col(f"_y{j}"))
    joined = own.where(test).join(places, on)
    side = lambda part: [F.lit(0).cast("long") if kind == "new" else moved_.get(k, F.lit(0).cast("long")) for kind, k, _ in part]
    flat = (*(len(r) for _, _, r in before), size_of(shape), *(len(r) for _, _, r in after))
    return Array.of(joined.select(ravel([*side(before), F.col("_q"), *side(after)], flat).alias(I), V), final, a.dtype)


def scattered(a: Array, updates, d: np.dtype) -> Array:
    """`a` with the cells of `updates` (i, v) put in; of several for a cell, any one."""
    new = updates.groupBy(I).agg(F.max_by(V, "_q").alias("_n")).select(F.col(I).alias("_j"), "_n") if "_q" in updates.columns else updates.select(F.col(I).alias("_j"), F.col(V).alias("_n"))
    joined = a.df.join(new, F.col(I) == F.col("_j"), "left")
    return Array.of(joined.select(I, F.when(F.col("_j").isNotNull(), F.col("_n")).otherwise(F.col(V)).alias(V)), a.shape, d)


def put(a, indices, values, mode: str = "raise") -> Array:
    """With values at flat places (values repeat as needed; of several for a place, the last)."""
    a, at, v = asarray(a), _ints(indices), asarray(values)
    v = v.astype(a.dtype)
    rows = at.df.select(F.col(I).alias("_q"), _mode(F.col(V), a.size, mode).alias(I))
    vals = v.df.select(F.col(I).alias("_m"), V)
    rows = rows.join(vals, F.pmod(F.col("_q"), F.lit(max(1, v.size))) == F.col("_m"))
    return scattered(a, rows.select(I, V, "_q"), a.dtype)


def _along(a: Array, indices: Array, k: int):
    shape = indices.shape
    source = lambda cs, v: ravel([v if j == k else c for j, c in enumerate(cs)], a.shape)
    at = indices.df.select(F.col(I).alias("_q"), _wrapped(F.col(V), a.shape[k]).alias("_x"))
    return at.select("_q", source([F.lit(0) if a.shape[j] == 1 else c for j, c in enumerate(coords(F.col("_q"), shape))], F.col("_x")).alias("_s"))


def take_along_axis(a, indices, axis=-1) -> Array:
    a, at = asarray(a), _ints(indices)
    if axis is None:
        a, axis = a.reshaped((a.size,)), 0
    (k,) = axes_of(axis, a.ndim)
    places = _along(a, at, k)
    return Array.of(a.df.join(places, F.col(I) == F.col("_s")).select(F.col("_q").alias(I), V), at.shape, a.dtype)


def put_along_axis(a, indices, values, axis) -> Array:
    from loomarray.operators.shape import broadcast_to

    a, at = asarray(a), _ints(indices)
    if axis is None:
        a, axis = a.reshaped((a.size,)), 0
    (k,) = axes_of(axis, a.ndim)
    v = broadcast_to(asarray(values).astype(a.dtype), at.shape)
    rows = _along(a, at, k).join(v.df, F.col("_q") == F.col(I)).select(F.col("_s").alias(I), V, "_q")
    return scattered(a, rows, a.dtype)


def choose(a, choices, mode: str = "raise") -> Array:
    """Each cell of the array its number says."""
    c = _ints(a)
    arrays = [asarray(x) for x in choices]
    d = np.result_type(*(x.dtype for x in arrays))

    def f(k, *v):
        k = _mode(k, len(arrays), mode) if mode != "raise" else _wrapped(F.when(k < 0, F.lit(len(arrays))).otherwise(k), len(arrays))
        out = dt.cast(v[0], arrays[0].dtype, d)
        for j in range(1, len(v)):
            out = F.when(k == j, dt.cast(v[j], arrays[j].dtype, d)).otherwise(out)
        return F.when(k >= 0, out)

    return mapped(f, d, c, *arrays)


def select(conditions, choices, default=0) -> Array:
    """The choice of the first condition that is true."""
    cs, xs = [asarray(c) for c in conditions], [asarray(np.asarray(x)) if not isinstance(x, Array) else x for x in choices]
    d = np.result_type(*(x.dtype for x in xs), default) if isinstance(default, (int, float, complex)) else np.result_type(*(x.dtype for x in xs))

    def f(*v):
        out = dt.lit(default, d)
        for c, x, arr in reversed(list(zip(v[: len(cs)], v[len(cs) :], xs, strict=True))):
            out = F.when(c, dt.cast(x, arr.dtype, d)).otherwise(out)
        return out

    return mapped(f, d, *cs, *xs)


def place(a, mask, values) -> Array:
    """With values, in turn, where a mask is true."""
    from loomarray.operators.sorting import flatnonzero

    return put(a, flatnonzero(mask), values)


def putmask(a, mask, values) -> Array:
    """With values of the same place (repeated as needed) where a mask is true."""
    a, m, v = asarray(a), asarray(mask), asarray(values)
    v = v.astype(a.dtype)
    if v.shape != a.shape:
        from loomarray.operators.shape import resize

        v = resize(v, a.shape)
    return mapped(lambda x, t, y: F.when(t, y).otherwise(x), a.dtype, a, m.astype(np.bool_), v)


def copyto(dst, src, where=True) -> Array:
    from loomarray.operators.shape import broadcast_to

    a = asarray(dst)
    v = broadcast_to(asarray(src).astype(a.dtype), a.shape)
    return mapped(lambda x, t, y: F.when(t, y).otherwise(x), a.dtype, a, asarray(np.asarray(where)) if not isinstance(where, Array) else where, v)


def fill_diagonal(a, value, wrap: bool = False) -> Array:
    a = asarray(a)
    v = np.asarray(value, a.dtype).ravel()
    step = a.shape[1] + 1 if a.ndim == 2 else sum(math.prod(a.shape[k + 1 :]) for k in range(a.ndim))
    end = a.size if wrap or a.ndim != 2 else min(a.size, a.shape[1] * a.shape[1])
    values = F.array(*(dt.lit(x, a.dtype) for x in v.tolist()))

    def f(x, i):
        on = (i % step == 0) & (i < end)
        return F.when(on, F.get(values, (F.call_function("div", i, F.lit(step)) % len(v)).cast("int"))).otherwise(x)

    return mapped(f, a.dtype, a, generated(a.shape, I64, lambda i: i))


def fill(a, value) -> Array:
    a = asarray(a)
    return generated(a.shape, a.dtype, lambda i: dt.lit(value, a.dtype))


# ---- index arrays
def indices(dimensions, dtype=np.int64, sparse: bool = False):
    shape = tuple(dimensions)
    if sparse:
        return tuple(generated(tuple(d if j == k else 1 for j, d in enumerate(shape)), dtype, lambda i: i.cast(dt.spark_type(np.dtype(dtype)))) for k in range(len(shape)))
    n = size_of(shape)

    def f(i):
        axis, cell = F.call_function("div", i, F.lit(max(1, n))), i % F.lit(max(1, n))
        out = F.lit(0).cast("long")
        for k, c in enumerate(coords(cell, shape)):
            out = F.when(axis == k, c).otherwise(out)
        return dt.cast(out, I64, np.dtype(dtype))

    return generated((len(shape), *shape), dtype, f)


def ix_(*args) -> tuple[Array, ...]:
    from loomarray.operators.sorting import flatnonzero

    out = []
    for k, x in enumerate(args):
        a = asarray(np.asarray(x)) if not isinstance(x, Array) else x
        a = flatnonzero(a) if a.dtype.kind == "b" else a
        out.append(a.reshaped(tuple(a.size if j == k else 1 for j in range(len(args)))))
    return tuple(out)


def ravel_multi_index(multi_index, dims, mode: str = "raise") -> Array:
    arrays = [_ints(x) for x in multi_index]

    def f(*v):
        out = []
        for c, n in zip(v, dims, strict=True):
            bad = F.when((c < 0) | (c >= n), F.raise_error(F.lit("invalid entry in coordinates array")).cast("long")).otherwise(c)
            out.append(bad if mode == "raise" else _mode(c, n, mode))
        return ravel(out, dims)

    return mapped(f, I64, *arrays)


def unravel_index(index, shape) -> tuple[Array, ...]:
    a = _ints(index)
    shape = tuple([shape] if np.isscalar(shape) else shape)
    n = size_of(shape)
    safe = a.with_value(lambda v: F.when((v < 0) | (v >= n), F.raise_error(F.lit("index is out of bounds for array")).cast("long")).otherwise(v), I64)
    return tuple(safe.with_value(lambda v, k=k: coords(v, shape)[k].cast("long"), I64) for k in range(len(shape)))


def diag_indices(n: int, ndim: int = 2) -> tuple[Array, ...]:
    return tuple(generated((n,), I64, lambda i: i) for _ in range(ndim))


def diag_indices_from(a) -> tuple[Array, ...]:
    a = asarray(a)
    return diag_indices(a.shape[0], a.ndim)


def _triangle(n: int, k: int, m: int | None, upper: bool) -> tuple[Array, Array]:
    from loomarray.operators.sorting import nonzero

    m = n if m is None else m

    def f(i):
        r, c = coords(i, (n, m))
        return (c - r >= k) if upper else (c - r <= k)

    return nonzero(generated((n, m), np.bool_, f))


def tril_indices(n: int, k: int = 0, m: int | None = None):
    return _triangle(n, k, m, False)


def triu_indices(n: int, k: int = 0, m: int | None = None):
    return _triangle(n, k, m, True)


def tril_indices_from(a, k: int = 0):
    a = asarray(a)
    return tril_indices(a.shape[-2], k, a.shape[-1])


def triu_indices_from(a, k: int = 0):
    a = asarray(a)
    return triu_indices(a.shape[-2], k, a.shape[-1])


def mask_indices(n: int, mask_func, k: int = 0):
    from loomarray.operators.creation import ones
    from loomarray.operators.sorting import nonzero

    return nonzero(mask_func(ones((n, n), np.int64), k))


# ---- comparisons of whole arrays
def array_equal(a, b, equal_nan: bool = False) -> bool:
    from loomarray.cells import elementwise
    from loomarray.operators.reductions import all as all_

    a, b = asarray(a), asarray(b)
    if a.shape != b.shape:
        return False
    same = elementwise("equal", a, b)
    if equal_nan:
        same = elementwise("logical_or", same, elementwise("logical_and", elementwise("isnan", a), elementwise("isnan", b)))
    return bool(all_(same).item())


def array_equiv(a, b) -> bool:
    from loomarray.cells import elementwise
    from loomarray.operators.reductions import all as all_

    a, b = asarray(a), asarray(b)
    try:
        np.broadcast_shapes(a.shape, b.shape)
    except ValueError:
        return False
    return bool(all_(elementwise("equal", a, b)).item())


def apply_along_axis(f, axis: int, a, *args, **kwargs) -> Array:
    """`f` of NumPy vectors on every line along an axis; its result on a line of ones tells shape and type."""
    from loomarray.operators.dense import blocks
    from loomarray.operators.shape import moveaxis

    a = asarray(a)
    (k,) = axes_of(axis, a.ndim)
    probe = np.asarray(f(np.ones(a.shape[k], a.dtype), *args, **kwargs))
    (out,) = blocks(a, [k], lambda v: np.asarray(f(v, *args, **kwargs)), [(probe.shape, dt.dtype(probe.dtype))])
    n = probe.ndim
    return moveaxis(out, list(range(out.ndim - n, out.ndim)), list(range(k, k + n))) if n else out


def may_share_memory(a, b) -> bool:
    """Arrays never change, so nothing that is shared can show."""
    return False


shares_memory = may_share_memory
_errors = {"divide": "warn", "over": "warn", "under": "ignore", "invalid": "warn"}


def geterr() -> dict:
    return dict(_errors)


def seterr(all=None, divide=None, over=None, under=None, invalid=None) -> dict:  # noqa: A002
    """Settings are kept; expressions give infinities and NaN and never warn."""
    old = dict(_errors)
    for k, v in {"divide": divide, "over": over, "under": under, "invalid": invalid}.items():
        _errors[k] = v or all or _errors[k]
    return old


del gather
