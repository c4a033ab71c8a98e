"""Scans and neighbours along an axis: windows over bounded chunks of a line, joined up by chunk totals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, asarray, axes_of, coords, elementwise, ravel
from loomarray.functions import elementwise as ew

#: Cells of a line that one window holds.
CHUNK = 1 << 16


def lines(a: Array, axis: int) -> DataFrame:
    """Columns _o (line), _p (place in it), i, v."""
    cs = coords(F.col(I), a.shape)
    rest = [k for k in range(a.ndim) if k != axis]
    return a.df.select(I, V, ravel([cs[k] for k in rest], [a.shape[k] for k in rest]).alias("_o"), cs[axis].alias("_p"))


def scan(df: DataFrame, length: int, total, join_up, chunk: int) -> DataFrame:
    """`df` (_o, _p, v, ...) with v scanned along _p: running totals in chunks, then of the chunks' totals."""
    if length <= chunk:
        w = Window.partitionBy("_o").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(V, total(F.col(V)).over(w))
    df = df.withColumn("_c", F.call_function("div", F.col("_p"), F.lit(chunk)))
    sums = df.groupBy("_o", "_c").agg(total(F.col(V)).alias(V)).withColumnRenamed("_c", "_p")
    sums = scan(sums, -(-length // chunk), total, join_up, chunk).select("_o", (F.col("_p") + 1).alias("_c"), F.col(V).alias("_before"))
    w = Window.partitionBy("_o", "_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = df.withColumn(V, total(F.col(V)).over(w))
    joined = own.join(sums, ["_o", "_c"], "left")
    return joined.withColumn(V, F.when(F.col("_before").isNull(), F.col(V)).otherwise(join_up(F.col("_before"), F.col(V)))).drop("_c", "_before")


def _line(a, axis) -> tuple[Array, int]:
    a = asarray(a)
    if axis is None:
        return a.reshaped((a.size,)), 0
    (k,) = axes_of(axis, a.ndim)
    return a, k


def cumsum(a, axis=None, dtype=None, chunk: int = CHUNK) -> Array:
    from loomarray.operators.reductions import sum_type

    a, k = _line(a, axis)
    d = np.dtype(dtype) if dtype is not None else sum_type(a.dtype)
    x = a.astype(d)
    if d.kind == "c":
        parts = [Array(x.frame, x.index, x.value[p].cast("double"), x.shape, np.float64) for p in ("re", "im")]
        re, im = (cumsum(p, k, chunk=chunk) for p in parts)
        from loomarray.cells import mapped

        return mapped(lambda r, i: dt.cplx(r, i, d), d, re, im)
    wide = "double" if d.kind == "f" else "decimal(38,0)" if d.itemsize == 8 and a.dtype.itemsize == 8 else "long"
    df = lines(x, k).withColumn(V, F.col(V).cast(wide))
    out = scan(df, x.shape[k], F.sum, lambda before, own: (before + own).cast(wide), chunk)
    value = ew.shaped(F.col(V), d) if d.kind == "f" else dt.wrap(F.col(V), d) if wide.startswith("dec") else F.col(V).cast(dt.spark_type(d))
    return Array.of(out.select(I, value.alias(V)), x.shape, d)


def cumprod(a, axis=None, dtype=None, chunk: int = CHUNK) -> Array:
    from loomarray.operators.reductions import sum_type

    a, k = _line(a, axis)
    d = np.dtype(dtype) if dtype is not None else sum_type(a.dtype)
    x = a.astype(d)
    if d.kind == "f":
        df = lines(x, k).withColumn(V, F.col(V).cast("double"))
        out = scan(df, x.shape[k], F.product, lambda before, own: before * own, chunk)
        return Array.of(out.select(I, ew.shaped(F.col(V), d).alias(V)), x.shape, d)
    # integers wrap and complex numbers turn: no window has that, so NumPy takes a chunk of a line at a time
    n = x.shape[k]
    if n <= chunk:
        from loomarray.operators.dense import along

        return along(x, k, lambda m: np.cumprod(m, axis=-1, dtype=d), n, d)
    return _in_chunks(x, k, d, chunk)


def _in_chunks(x: Array, k: int, d: np.dtype, chunk: int) -> Array:
    """Products along a line longer than a chunk: within chunks, times the products of the chunks before."""
    from loomarray.cells import mapped
    from loomarray.operators.dense import along
    from loomarray.operators.shape import moveaxis, pad

    n, parts = x.shape[k], -(-x.shape[k] // chunk)
    line = moveaxis(x, k, -1)
    lead = line.shape[:-1]
    full = pad(line, [*((0, 0) for _ in lead), (0, parts * chunk - n)], constant_values=1).reshaped((*lead, parts, chunk))
    own = along(full, len(lead) + 1, lambda m: np.cumprod(m, axis=-1, dtype=d), chunk, d)
    whole = own[(..., chunk - 1)]  # of each chunk
    upto = cumprod(whole, len(lead), d, chunk)
    before = pad(upto[(..., slice(0, parts - 1))], [*((0, 0) for _ in lead), (1, 0)], constant_values=1)
    out = mapped(lambda b, v: ew.multiply(d, b, v), d, before.reshaped((*lead, parts, 1)), own)
    out = out.reshaped((*lead, parts * chunk))[(..., slice(0, n))]
    return moveaxis(out, -1, k)


def nancumsum(a, axis=None) -> Array:
    from loomarray.operators.reductions import nan_to

    return cumsum(nan_to(a, 0), axis)


def nancumprod(a, axis=None) -> Array:
    from loomarray.operators.reductions import nan_to

    return cumprod(nan_to(a, 1), axis)


def shifted(a: Array, axis: int, by: int, chunk: int = CHUNK) -> tuple[DataFrame, Column, Column, Column]:
    """Every cell with the one `by` places on: (frame, own value, other value, whether there is none).

    Chunks of a line take along the cells next to them, so a line of any length is many windows.
    """
    (k,) = axes_of(axis, a.ndim)
    n = a.shape[k]
    df = lines(a, k)
    c = F.call_function("div", F.col("_p"), F.lit(chunk))
    far = F.call_function("div", F.greatest(F.least(F.col("_p") - by, F.lit(n - 1)), F.lit(0)), F.lit(chunk))
    if n > chunk:
        df = df.withColumn("_c", F.explode(F.array_distinct(F.array(c, far))))
    else:
        df = df.withColumn("_c", F.lit(0).cast("long"))
    w = Window.partitionBy("_o", "_c").orderBy("_p")
    other = (F.lead if by > 0 else F.lag)(V, abs(by)).over(w)
    there = (F.col("_p") + by >= 0) & (F.col("_p") + by < n)
    df = df.withColumn("_w", other).withColumn("_none", ~there)
    if n > chunk:
        df = df.where(c == F.col("_c"))
    return df, F.col(V), F.col("_w"), F.col("_none")


def diff(a, n: int = 1, axis: int = -1, prepend=None, append=None) -> Array:
    """Differences of neighbours, n times; values to `prepend` or `append` along the axis come first (a scalar is one slice)."""
    a = asarray(a)
    if n < 0:
        raise ValueError("order must be non-negative")
    (k,) = axes_of(axis, a.ndim)
    if prepend is not None or append is not None:
        from loomarray.operators.shape import broadcast_to, concatenate

        def ends(x):
            x = asarray(x)
            return x if x.ndim else broadcast_to(x, (*a.shape[:k], 1, *a.shape[k + 1 :]))

        a = concatenate([*([] if prepend is None else [ends(prepend)]), a, *([] if append is None else [ends(append)])], axis=k)
    name = "not_equal" if a.dtype.kind == "b" else "subtract"
    for _ in range(n):
        df, own, after, none = shifted(a, k, 1)
        shape = (*a.shape[:k], max(0, a.shape[k] - 1), *a.shape[k + 1 :])
        cs = coords(F.col(I), a.shape)
        value = ew.apply(name, [after, own], [a.dtype, a.dtype])[0]
        a = Array.of(df.where(~none).select(ravel(cs, shape).alias(I), value.alias(V)), shape, a.dtype)
    return a


def ediff1d(a, to_end=None, to_begin=None) -> Array:
    from loomarray.operators.shape import concatenate

    a = asarray(a)
    out = diff(a.reshaped((a.size,)))
    ends = [np.atleast_1d(np.asarray(x, a.dtype)).ravel() for x in (to_begin, to_end) if x is not None]
    parts = [*([asarray(ends[0])] if to_begin is not None else []), out, *([asarray(ends[-1])] if to_end is not None else [])]
    return concatenate(parts) if len(parts) > 1 else out


def gradient(f, *spacing, axis=None):
    """Second-order differences inside, first-order at the ends; spacing is a step or the coordinates of each axis."""
    f = asarray(f)
    if f.dtype.kind == "b":
        raise TypeError("not for booleans: it subtracts")
    axes = axes_of(axis, f.ndim)
    steps = list(spacing) or [1.0]
    if len(steps) == 1:
        steps = steps * len(axes)
    d = f.dtype if f.dtype.kind in "fc" else np.dtype("float64")
    x = f.astype(d)
    out = []
    for k, h in zip(axes, steps, strict=True):
        if f.shape[k] < 2:
            raise ValueError("at least two elements are needed")
        out.append(_slope(x, k, np.asarray(h.numpy() if isinstance(h, Array) else h, float)))
    return out[0] if len(axes) == 1 else out


def _slope(x: Array, k: int, h: np.ndarray) -> Array:
    n = x.shape[k]
    df, own, after, last = shifted(x, k, 1)
    df = df.withColumnsRenamed({"_w": "_after", "_none": "_last"}).drop("_c")
    # the other neighbour, by a second window over the same chunks
    both = Array.of(df.select(I, F.struct(V, "_after", "_last").alias(V)), x.shape, x.dtype)
    df, packed, before, first = shifted(both, k, -1)
    c, a, b = packed[V].cast("double"), packed["_after"].cast("double"), before[V].cast("double")
    last = packed["_last"]
    if h.ndim:
        gaps = F.array(*map(F.lit, np.diff(h).tolist()))
        p = F.col("_p").cast("int")
        right, left = F.get(gaps, p), F.get(gaps, p - 1)
    else:
        right = left = F.lit(float(h))
    inside = (left * left * a + (right * right - left * left) * c - right * right * b) / (left * right * (left + right)) if h.ndim else (a - b) / (2 * right)
    value = F.when(first, (a - c) / right).when(last, (c - b) / left).otherwise(inside)
    del n
    return Array.of(df.select(I, ew.shaped(value, x.dtype).alias(V)), x.shape, x.dtype)


def trapezoid(y, x=None, dx: float = 1.0, axis: int = -1) -> Array:
    """Integral by trapezoids."""
    from loomarray.operators.reductions import sum as sum_

    y = asarray(y)
    (k,) = axes_of(axis, y.ndim)
    y = y if y.dtype.kind in "fc" else y.astype(np.float64)
    df, own, after, none = shifted(y, k, 1)
    if x is None:
        width = F.lit(float(dx))
        pair = df.select(I, F.when(none, 0.0).otherwise((own + after) / 2 * width).alias(V))
        return sum_(Array.of(pair, y.shape, y.dtype), axis=k)
    x = asarray(x)
    gap = diff(x.astype(np.float64), axis=-1 if x.ndim == 1 else k)
    if x.ndim == 1:
        gap = gap.reshaped(tuple(gap.size if j == k else 1 for j in range(y.ndim)))
    shape = (*y.shape[:k], y.shape[k] - 1, *y.shape[k + 1 :])
    cs = coords(F.col(I), y.shape)
    mid = Array.of(df.where(~none).select(ravel(cs, shape).alias(I), ((own + after) / 2).alias(V)), shape, y.dtype)
    return sum_(elementwise("multiply", mid, gap), axis=k)


def convolve(a, v, mode: str = "full") -> Array:
    """Discrete convolution of two lines of any length (see `convolution.convolved`)."""
    a, v = asarray(a), asarray(v)
    return _slide(a, v, mode, False, (min(a.size, v.size) - 1) // 2)


def correlate(a, v, mode: str = "valid") -> Array:
    """Cross-correlation, c[k] = sum a[n + k] conj(v[n]): the convolution with the second line turned round."""
    a, v = asarray(a), asarray(v)
    if v.dtype.kind == "c":
        v = elementwise("conjugate", v)
    short = min(a.size, v.size)
    return _slide(a, v, mode, True, (short - 1) // 2 if a.size >= v.size else short // 2)


def _slide(a: Array, v: Array, mode: str, backwards: bool, half: int) -> Array:
    from loomarray.operators.convolution import convolved

    n, m = max(a.size, v.size), min(a.size, v.size)
    if not m:
        raise ValueError("an operand is empty")
    low, high = {"full": (0, n + m - 1), "same": (half, half + n), "valid": (m - 1, n)}[mode]
    return convolved(a, v, backwards, np.result_type(a.dtype, v.dtype), low, high)
