"""Reductions along axes: a group-by on the coordinates that stay, partial before the shuffle."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, asarray, axes_of, coords, elementwise, mapped, moved, ravel
from loomarray.functions import elementwise as ew

F64, I64, U64, BOOL = (np.dtype(x) for x in ("float64", "int64", "uint64", "bool"))


def sum_type(d: np.dtype) -> np.dtype:
    return I64 if d.kind in "bi" else U64 if d.kind == "u" else d


def mean_type(d: np.dtype) -> np.dtype:
    return d if d.kind in "fc" else F64


def numeric(a: Array) -> None:
    if a.dtype.kind == "b":
        raise TypeError("not for booleans: it subtracts")


def grouped(a: Array, axis, keepdims: bool, agg, dtype, where=None, placed: bool = False) -> Array:
    """`agg(value, position)` over each line; position counts along the axes reduced.  `where` is a mask array.

    Only with `placed` does the result depend on positions; a whole column is else read unnumbered.
    """
    axes = axes_of(axis, a.ndim)
    kept = [k for k in range(a.ndim) if k not in axes]
    shape = tuple(a.shape[k] for k in kept)
    final = tuple(1 if k in axes else d for k, d in enumerate(a.shape)) if keepdims else shape
    value = F.col(V)
    if not kept and where is None and not placed:
        return Array.of(a.bag.agg(agg(value, None).alias(V)).select(F.lit(0).cast("long").alias(I), V), final, dtype)
    if where is not None:
        a = mapped(lambda v, m: F.struct(v.alias("x"), m.cast("boolean").alias("m")), a.dtype, a, asarray(where))  # masked cells become null below
        df = a.frame.select(a.index.alias(I), a.value.alias("_s")).select(I, F.when(F.col("_s.m"), F.col("_s.x")).alias(V))
    else:
        df = a.df
    cs = coords(F.col(I), a.shape)
    position = ravel([cs[k] for k in axes], [a.shape[k] for k in axes])
    if not kept:
        out = df.agg(agg(value, position).alias(V)).select(F.lit(0).cast("long").alias(I), V)
    else:
        out = df.groupBy(ravel([cs[k] for k in kept], shape).alias("_o")).agg(agg(value, position).alias(V)).select(F.col("_o").alias(I), V)
    return Array.of(out, final, dtype)


def _with_initial(out: Array, initial, name: str) -> Array:
    return out if initial is None else elementwise(name, out, initial)


def _sum(d: np.dtype, v: Column) -> Column:
    if d.kind == "c":
        return dt.cplx(F.sum(v["re"].cast("double")), F.sum(v["im"].cast("double")), d)
    if d.kind == "f":
        return ew.shaped(F.sum(v.cast("double")), d)
    return dt.wrap(F.sum(v.cast("decimal(20,0)")).cast("decimal(38,0)"), d)


def sum(a, axis=None, keepdims: bool = False, dtype=None, where=None, initial=None) -> Array:  # noqa: A001
    a = asarray(a)
    d = np.dtype(dtype) if dtype is not None else sum_type(a.dtype)
    narrow = a.dtype.kind in "biu" and a.dtype.itemsize < 8 and d == I64 and a.size < 1 << 31  # then a long has room
    x = a.astype(d)
    zero = dt.lit(0, d)
    agg = (lambda v, p: F.coalesce(F.sum(v), zero)) if narrow else (lambda v, p: F.coalesce(_sum(d, v), zero))
    return _with_initial(grouped(x, axis, keepdims, agg, d, where), initial, "add")


def fold(a: Array, axis, keepdims: bool, step, start, dtype, where=None, chunk: int = 1024) -> Array:
    """Fold of each line by an associative `step`, in a tree: lists of at most `chunk` cells at a time."""
    axes = axes_of(axis, a.ndim)
    kept = [k for k in range(a.ndim) if k not in axes]
    shape = tuple(a.shape[k] for k in kept)
    length = math.prod(a.shape[k] for k in axes)
    if where is not None:
        a = mapped(lambda v, m: F.when(m.cast("boolean"), v).otherwise(dt.lit(start, a.dtype)), a.dtype, a, asarray(where))
    cs = coords(F.col(I), a.shape)
    df = a.df.select(ravel([cs[k] for k in kept], shape).alias("_o"), ravel([cs[k] for k in axes], [a.shape[k] for k in axes]).alias("_p"), V)
    one = dt.lit(start, dtype)
    while True:
        df = df.withColumn("_p", F.call_function("div", F.col("_p"), F.lit(chunk)))
        df = df.groupBy("_o", "_p").agg(F.aggregate(F.collect_list(V), one, step).alias(V))
        length = -(-length // chunk)
        if length <= 1:
            break
    final = tuple(1 if k in axes else d for k, d in enumerate(a.shape)) if keepdims else shape
    return Array.of(df.select(F.col("_o").alias(I), V), final, dtype)


def prod(a, axis=None, keepdims: bool = False, dtype=None, where=None, initial=None) -> Array:
    a = asarray(a)
    d = np.dtype(dtype) if dtype is not None else sum_type(a.dtype)
    x = a.astype(d)
    if d.kind == "f":
        out = grouped(x, axis, keepdims, lambda v, p: ew.shaped(F.coalesce(F.product(v.cast("double")), F.lit(1.0)), d), d, where)
    else:
        out = fold(x, axis, keepdims, lambda s, v: ew.multiply(d, s, v), 1, d, where)
    return _with_initial(out, initial, "multiply")


def _mean(d: np.dtype, v: Column) -> Column:
    if d.kind == "c":
        return dt.cplx(F.avg(v["re"].cast("double")), F.avg(v["im"].cast("double")), d)
    return ew.shaped(F.avg(v.cast("double")), d)


def mean(a, axis=None, keepdims: bool = False, where=None) -> Array:
    a = asarray(a)
    d = mean_type(a.dtype)
    return grouped(a.astype(d), axis, keepdims, lambda v, p: F.coalesce(_mean(d, v), dt.lit(math.nan, d)), d, where)


def _extreme(name: str):
    def pick(d: np.dtype, v: Column) -> Column:
        f = F.max if name == "maximum" else F.min
        if d.kind in "biu":
            return f(v)
        bad = ew.is_nan(v, d)
        if d.kind == "f":
            return f(v) if name == "maximum" else F.when(F.coalesce(F.bool_or(bad), F.lit(False)), dt.lit(math.nan, d)).otherwise(f(v))
        return F.coalesce(F.any_value(F.when(bad, v), ignoreNulls=True), f(v))

    def run(a, axis=None, keepdims: bool = False, where=None, initial=None) -> Array:
        a = asarray(a)
        if not a.size and initial is None:
            raise ValueError("zero-size array to reduction operation which has no identity")
        d = a.dtype
        low = None
        if where is not None:
            low = {"b": name == "minimum", "f": math.inf if name == "minimum" else -math.inf}.get(d.kind)
            if low is None and d.kind in "iu":
                low = np.iinfo(d).max if name == "minimum" else np.iinfo(d).min
        out = grouped(a, axis, keepdims, lambda v, p: pick(d, v) if low is None else F.coalesce(pick(d, v), dt.lit(low, d)), d, where)
        return _with_initial(out, initial, name)

    return run


max = amax = _extreme("maximum")  # noqa: A001
min = amin = _extreme("minimum")  # noqa: A001


def ptp(a, axis=None, keepdims: bool = False) -> Array:
    """Largest less smallest."""
    a = asarray(a)
    numeric(a)
    d = a.dtype

    def agg(v, p):
        low, high = F.min(v), F.max(v)
        if d.kind == "f":
            return ew.shaped(F.when(F.bool_or(F.isnan(v)), dt.lit(math.nan, d)).otherwise(high - low), d)
        return ew.KERNELS["subtract"](d, high, low)

    return grouped(a, axis, keepdims, agg, d)


def _arg(name: str):
    def run(a, axis=None, keepdims: bool = False) -> Array:
        a = asarray(a)
        if not a.size:
            raise ValueError("attempt to get argmax or argmin of an empty sequence")
        d = a.dtype

        def agg(v, p):
            key = F.struct(v["re"], v["im"]) if d.kind == "c" else v
            bad = ew.is_nan(v, d)
            if name == "max":
                return F.max_by(p, F.struct(bad, key, -p))
            return F.min_by(p, F.struct(~bad, key, p))

        return grouped(a, axis, keepdims, agg, I64, placed=True)

    return run


argmax, argmin = _arg("max"), _arg("min")


def _moment(d: np.dtype, v: Column, ddof: float, root: bool) -> Column:
    real = dt.part(mean_type(d))
    if d.kind == "c":
        n, m = F.count(v), F.var_pop(v["re"].cast("double")) + F.var_pop(v["im"].cast("double"))
    else:
        n, m = F.count(v), F.var_pop(v.cast("double"))
    out = ew.divided(m * n, F.greatest(n - F.lit(float(ddof)), F.lit(0.0))) if ddof else m
    out = F.coalesce(out, F.lit(math.nan))
    return ew.shaped(F.sqrt(out) if root else out, real)


def var(a, axis=None, ddof: float = 0, keepdims: bool = False, where=None) -> Array:
    a = asarray(a)
    x = a.astype(mean_type(a.dtype))
    return grouped(x, axis, keepdims, lambda v, p: _moment(a.dtype, v, ddof, False), dt.part(x.dtype), where)


variance = var_ = var


def std(a, axis=None, ddof: float = 0, keepdims: bool = False, where=None) -> Array:
    a = asarray(a)
    x = a.astype(mean_type(a.dtype))
    return grouped(x, axis, keepdims, lambda v, p: _moment(a.dtype, v, ddof, True), dt.part(x.dtype), where)


def at_places(keys: DataFrame, n: int, want: Sequence[int]) -> dict:
    """What stands at places of a line of n values (column k) once it is sorted.

    Ranges are counted, and only those that hold a wanted place are looked into, by their values' running
    counts.  Nothing is sorted as a whole and a value for each place comes to the driver.
    """
    from loomarray.cells import ranged

    df, before = ranged(keys, F.col("k"), n)
    starts = sorted(before, key=before.get)
    at = {w: starts[int(np.searchsorted([before[r] for r in starts], w, side="right")) - 1] for w in want}
    own = df.where(F.col("_range").isin(*set(at.values()))).groupBy("_range", "k").agg(F.count("*").alias("_n"))
    upto = own.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_range").orderBy("k")))
    hit = F.lit(False)
    for w, r in at.items():
        hit = hit | ((F.col("_range") == r) & (F.col("_upto") > w - before[r]) & (F.col("_upto") - F.col("_n") <= w - before[r]))
    found = upto.where(hit).collect()
    return {w: next(r["k"] for r in found if r["_range"] == k and r["_upto"] - r["_n"] <= w - before[k] < r["_upto"]) for w, k in at.items()}


def _at(a: Array, q: list[float]) -> list[float]:
    """Quantiles of all values."""
    n = a.size
    want = sorted({int(x) for p in q for x in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    if a.dtype.kind == "f" and math.isnan(a.bag.agg(F.max(V)).first()[0]):  # NaN is above all
        return [math.nan] * len(q)
    got = {w: float(x) for w, x in at_places(a.bag.select(F.col(V).alias("k")), n, want).items()}
    out = []
    for p in q:
        x = p * (n - 1)
        lo, hi = math.floor(x), math.ceil(x)
        out.append(got[lo] if got[lo] == got[hi] else (hi - x) * got[lo] + (x - lo) * got[hi])  # as `percentile` does: inf stays inf
    return out


#: Quantiles of more cells than this go by ranges.
GATHERED = 1 << 18


def quantile(a, q, axis=None, keepdims: bool = False) -> Array:
    """Linear interpolation between the sorted values around q (n - 1)."""
    a = asarray(a)
    numeric(a)
    qs = np.asarray(q, float)
    if ((qs < 0) | (qs > 1)).any():
        raise ValueError("Quantiles must be in the range [0, 1]")
    d = mean_type(a.dtype)
    outs = []
    axes = axes_of(axis, a.ndim)
    if len(axes) == a.ndim and a.size > GATHERED:
        shape = (1,) * a.ndim if keepdims else ()
        outs = [asarray(np.array(x, d)).reshaped(shape) for x in _at(a, qs.ravel().tolist())]
    else:
        for p in qs.ravel().tolist():
            outs.append(grouped(a, axis, keepdims, lambda v, _, p=p: ew.shaped(F.when(F.bool_or(ew.is_nan(v, a.dtype)), math.nan).otherwise(F.coalesce(F.percentile(v.cast("double"), F.lit(p)), F.lit(math.nan))), d), d))
    if not qs.ndim:
        return outs[0]
    from loomarray.operators.shape import stack

    out = stack(outs)
    return out.reshaped((*qs.shape, *outs[0].shape))


def percentile(a, q, axis=None, keepdims: bool = False) -> Array:
    return quantile(a, np.asarray(q, float) / 100, axis, keepdims)


def median(a, axis=None, keepdims: bool = False) -> Array:
    a = asarray(a)
    return quantile(a.astype(F64) if a.dtype.kind == "b" else a, 0.5, axis, keepdims)


def average(a, axis=None, weights=None, returned: bool = False, keepdims: bool = False):
    a = asarray(a)
    if weights is None:
        out = mean(a, axis, keepdims)
        scale = asarray(np.full(out.shape, a.size / out.size if out.size else 0.0))
    else:
        w = asarray(weights)
        if w.shape != a.shape:
            (k,) = axes_of(axis, a.ndim)
            w = w.reshaped(tuple(d if j == k else 1 for j, d in enumerate(a.shape)))
        scale = sum(mapped(lambda x, y: y, w.dtype, a, w), axis, keepdims)
        out = elementwise("divide", sum(elementwise("multiply", a, w), axis, keepdims), scale)
    return (out, scale) if returned else out


def all(a, axis=None, keepdims: bool = False, where=None) -> Array:  # noqa: A001
    return grouped(asarray(a).astype(BOOL), axis, keepdims, lambda v, p: F.coalesce(F.bool_and(v), F.lit(True)), BOOL, where)


def any(a, axis=None, keepdims: bool = False, where=None) -> Array:  # noqa: A001
    return grouped(asarray(a).astype(BOOL), axis, keepdims, lambda v, p: F.coalesce(F.bool_or(v), F.lit(False)), BOOL, where)


def count_nonzero(a, axis=None, keepdims: bool = False) -> Array:
    return grouped(asarray(a).astype(BOOL), axis, keepdims, lambda v, p: F.count_if(v), I64)


# ---- the same without NaN
def _known(a: Array) -> Array:
    """NaN to null, which aggregates leave out."""
    return a if a.dtype.kind in "biu" else a.with_value(lambda v: F.when(~ew.is_nan(v, a.dtype), v), a.dtype)


def nansum(a, axis=None, keepdims: bool = False) -> Array:
    return sum(nan_to(a, 0), axis, keepdims)


def nan_to(a, value) -> Array:
    a = asarray(a)
    return a if a.dtype.kind in "biu" else a.with_value(lambda v: F.when(ew.is_nan(v, a.dtype), dt.lit(value, a.dtype)).otherwise(v), a.dtype)


def nanprod(a, axis=None, keepdims: bool = False) -> Array:
    return prod(nan_to(a, 1), axis, keepdims)


def nanmean(a, axis=None, keepdims: bool = False) -> Array:
    return mean(_known(asarray(a)), axis, keepdims)


def nanvar(a, axis=None, ddof: float = 0, keepdims: bool = False) -> Array:
    return var(_known(asarray(a)), axis, ddof, keepdims)


def nanstd(a, axis=None, ddof: float = 0, keepdims: bool = False) -> Array:
    return std(_known(asarray(a)), axis, ddof, keepdims)


def nanmax(a, axis=None, keepdims: bool = False) -> Array:
    a = asarray(a)
    return grouped(_known(a), axis, keepdims, lambda v, p: F.coalesce(F.max(v), dt.lit(math.nan, a.dtype)) if a.dtype.kind in "fc" else F.max(v), a.dtype)


def nanmin(a, axis=None, keepdims: bool = False) -> Array:
    a = asarray(a)
    return grouped(_known(a), axis, keepdims, lambda v, p: F.coalesce(F.min(v), dt.lit(math.nan, a.dtype)) if a.dtype.kind in "fc" else F.min(v), a.dtype)


def _nanarg(name: str):
    def run(a, axis=None, keepdims: bool = False) -> Array:
        a = asarray(a)

        def agg(v, p):
            ok = F.when(~ew.is_nan(v, a.dtype), p)
            found = F.max_by(ok, F.when(ok.isNotNull(), F.struct(v, -p))) if name == "max" else F.min_by(ok, F.when(ok.isNotNull(), F.struct(v, p)))
            return F.coalesce(found, F.raise_error(F.lit("All-NaN slice encountered")).cast("long"))

        return grouped(a, axis, keepdims, agg, I64, placed=True)

    return run


nanargmax, nanargmin = _nanarg("max"), _nanarg("min")


def nanquantile(a, q, axis=None, keepdims: bool = False) -> Array:
    a = asarray(a)
    numeric(a)
    qs = np.asarray(q, float)
    d = mean_type(a.dtype)
    outs = [grouped(_known(a), axis, keepdims, lambda v, _, p=p: ew.shaped(F.coalesce(F.percentile(v.cast("double"), F.lit(p)), F.lit(math.nan)), d), d) for p in qs.ravel().tolist()]
    if not qs.ndim:
        return outs[0]
    from loomarray.operators.shape import stack

    return stack(outs).reshaped((*qs.shape, *outs[0].shape))


def nanpercentile(a, q, axis=None, keepdims: bool = False) -> Array:
    return nanquantile(a, np.asarray(q, float) / 100, axis, keepdims)


def nanmedian(a, axis=None, keepdims: bool = False) -> Array:
    return nanquantile(a, 0.5, axis, keepdims)


def apply_over_axes(f, a, axes) -> Array:
    """`f(a, axis)` for one axis after the other, keeping dimensions."""
    a = asarray(a)
    for axis in np.atleast_1d(axes).tolist():
        out = f(a, axis)
        if out.ndim < a.ndim:
            (k,) = axes_of(axis, a.ndim)
            out = out.reshaped((*out.shape[:k], 1, *out.shape[k:]))
        a = out
    return a


from loomarray.operators.scans import cumprod, cumsum, nancumprod, nancumsum  # noqa: E402

cumulative_sum, cumulative_prod = cumsum, cumprod
del moved
__all__ = ["cumprod", "cumsum", "nancumprod", "nancumsum"]
