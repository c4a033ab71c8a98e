"""Sorting, searching, sets, counting: windows within lines, range sorts across the cluster for whole arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, asarray, axes_of, coords, gather, mapped, numbered, ravel
from loomarray.functions import elementwise as ew
from loomarray.operators.scans import lines

I64, F64, BOOL = np.dtype("int64"), np.dtype("float64"), np.dtype("bool")


def key(d: np.dtype, v: Column) -> Column:
    """What sorts as NumPy does: NaN last, complex by real part and then imaginary, one zero."""
    if d.kind == "c":
        re, im = v["re"] + F.lit(0.0), v["im"] + F.lit(0.0)
        return F.struct(F.isnan(re) | F.isnan(im), re, im)
    return v + F.lit(0).cast(dt.spark_type(d)) if d.kind == "f" else v


def _ranked(a: Array, axis, by=None) -> tuple[DataFrame, tuple[int, ...], int]:
    """Lines with the rank _r of each cell in its line (ties by place), and the shape."""
    if axis is None:
        a, axis = a.reshaped((a.size,)), 0
    (k,) = axes_of(axis, a.ndim)
    df = lines(a, k)
    order = [key(a.dtype, F.col(V)), F.col("_p")] if by is None else by
    if a.ndim == 1:  # one line: a range sort over the cluster
        df, _ = numbered(df, *order, name="_r", n=a.size)
    else:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy("_o").orderBy(*order)) - 1)
    return df, a.shape, k


def _to(df: DataFrame, shape, k: int, value: Column, dtype) -> Array:
    """Cells at (line, rank)."""
    rest = [s for j, s in enumerate(shape) if j != k]
    cs = coords(F.col("_o"), rest)
    cs.insert(k, F.col("_r").cast("long"))
    return Array.of(df.select(ravel(cs, shape).alias(I), value.alias(V)), shape, dtype)


def sort(a, axis=-1) -> Array:
    a = asarray(a)
    df, shape, k = _ranked(a, axis)
    return _to(df, shape, k, F.col(V), a.dtype)


def argsort(a, axis=-1) -> Array:
    a = asarray(a)
    df, shape, k = _ranked(a, axis)
    return _to(df, shape, k, F.col("_p").cast("long"), I64)


def _parted(a: Array, kth) -> DataFrame:
    """A line's cells with a place `_r` each: those at the places `kth` are what a sort puts there, smaller
    ones stand before them and larger ones after, and cells between the same places keep their order.

    The values at those places are found by counting ranges (`at_places`); a cell's class follows from them, and its
    place from counts of the classes in chunks of the line.  Nothing is sorted.
    """
    from loomarray.cells import _literal, div
    from loomarray.operators.reductions import at_places
    from loomarray.operators.scans import CHUNK

    n = a.size
    places = sorted({int(k) for k in np.ravel(kth)})
    if any(not -n <= k < n for k in places):
        raise ValueError(f"kth(={next(k for k in places if not -n <= k < n)}) out of bounds ({n})")
    places = sorted({k % n for k in places})
    k = key(a.dtype, F.col(V))
    keys = a.bag.select(k.alias("k"))
    pivots = list({repr(x): x for x in at_places(keys, n, places).values()}.values())  # ascending, as the places are
    edges = [_literal(x, keys.schema["k"].dataType) for x in pivots]
    kind = F.lit(0)
    for e in edges:
        kind = kind + F.when(k > e, 2).when(k.eqNullSafe(e), 1).otherwise(0)
    cells = lines(a, 0).withColumn("_k", kind).withColumn("_c", div(F.col("_p"), CHUNK))
    sums = cells.groupBy("_c", "_k").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = dict(sums.groupBy("_k").agg(F.sum("_n")).collect())  # two for each place, and one
    order = sorted(totals)
    start = dict(zip(order, np.cumsum([0, *(totals[x] for x in order[:-1])]).tolist(), strict=True))
    first = F.lit(0).cast("long")
    for x in order:
        first = F.when(F.col("_k") == x, F.lit(start[x]).cast("long")).otherwise(first)
    sums = sums.select("_c", "_k", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + first).alias("_s"))
    rank = F.row_number().over(Window.partitionBy("_c", "_k").orderBy("_p")) - 1
    return cells.withColumn("_i", rank).join(sums, ["_c", "_k"]).withColumn("_r", F.col("_i") + F.col("_s"))


def _partition(a, kth, axis, value: str) -> Array | None:
    a = asarray(a)
    if axis is None or a.ndim == 1:
        a = a.reshaped((a.size,))
        if a.size:
            return _to(_parted(a, kth), a.shape, 0, F.col(value), a.dtype if value == V else I64)
    return None


def partition(a, kth, axis=-1) -> Array:
    """What a sort puts at the places `kth`, smaller values before and larger ones after.  A line as a whole is not sorted (see `_parted`); lines along an axis are."""
    out = _partition(a, kth, axis, V)
    return sort(a, axis) if out is None else out


def argpartition(a, kth, axis=-1) -> Array:
    """The places of what `partition` gives."""
    out = _partition(a, kth, axis, "_p")
    return argsort(a, axis) if out is None else out


def lexsort(keys, axis: int = -1) -> Array:
    """Order by several keys; the last is the first to count."""
    keys = [asarray(x) for x in (list(keys) if isinstance(keys, (list, tuple)) else [keys])]
    if len(keys) == 1 and keys[0].ndim > 1:
        from loomarray.operators.shape import unstack

        keys = unstack(keys[0])
    packed = mapped(lambda *v: F.struct(*(key(x.dtype, c).alias(f"k{j}") for j, (x, c) in enumerate(zip(keys, v, strict=True)))), F64, *keys)
    by = [F.col(V)[f"k{j}"] for j in range(len(keys) - 1, -1, -1)] + [F.col("_p")]
    df, shape, k = _ranked(packed, axis, by)
    return _to(df, shape, k, F.col("_p").cast("long"), I64)


def sort_complex(a) -> Array:
    a = asarray(a)
    return sort(a.astype(np.result_type(a.dtype, np.complex64)))


# ---- where things are
def _kept(a: Array, mask: Column | None = None) -> tuple[DataFrame, int]:
    """Cells that are true (or where `mask` is), numbered in order: _n, i, v."""
    test = dt.cast(F.col(V), a.dtype, BOOL) if mask is None else mask
    return numbered(a.df.where(test), I, name="_n")


def flatnonzero(a) -> Array:
    df, n = _kept(asarray(a))
    return Array.of(df.select(F.col("_n").alias(I), F.col("i").alias(V)) if I != "_n" else df, (n,), I64)


def nonzero(a) -> tuple[Array, ...]:
    a = asarray(a)
    df, n = _kept(a)
    df = df.withColumnRenamed(I, "_i")
    index = F.col("_n")
    return tuple(Array(df, index, c.cast("long"), (n,), I64) for c in coords(F.col("_i"), a.shape))


def argwhere(a) -> Array:
    from loomarray.operators.shape import stack

    a = asarray(a)
    at = nonzero(a)
    return stack(at, axis=1) if at else asarray(np.empty((0, 0), np.int64))


def where(condition, x=None, y=None):
    if x is None and y is None:
        return nonzero(condition)
    c = asarray(condition)
    x, y = (v if isinstance(v, Array) else asarray(np.asarray(v)) for v in (x, y))
    d = np.result_type(x.dtype, y.dtype)
    return mapped(lambda m, p, q: F.when(dt.cast(m, c.dtype, BOOL), dt.cast(p, x.dtype, d)).otherwise(dt.cast(q, y.dtype, d)), d, c, x, y)


def extract(condition, a) -> Array:
    """Cells where a condition of the same size is true, in order."""
    a, c = asarray(a), asarray(condition)
    both = mapped(lambda v, m: F.struct(v.alias("x"), m.alias("m")), a.dtype, a.reshaped((a.size,)), c.reshaped((c.size,)).astype(BOOL))
    df, n = _kept(both, F.col(V)["m"])
    return Array.of(df.select(F.col("_n").alias(I), F.col(V)["x"].alias(V)), (n,), a.dtype)


def compress(condition, a, axis=None) -> Array:
    a = asarray(a)
    mask = np.asarray(condition.numpy() if isinstance(condition, Array) else condition, bool)
    from loomarray.operators.indexing import take

    return take(a, np.flatnonzero(mask), axis)


def searchsorted(a, v, side: str = "left", sorter=None) -> Array:
    """Where to put values in a sorted array so that it stays sorted: the number of edges before each, by an as-of merge."""
    from loomarray.operators.merging import asof

    a, v = asarray(a), asarray(v)
    if sorter is not None:
        from loomarray.operators.indexing import take

        a = take(a, sorter)
    d = np.result_type(a.dtype, v.dtype)
    edges = a.bag.select(key(d, dt.cast(F.col(V), a.dtype, d)).alias("x"), F.lit(0).alias("y"))
    values = v.df.select(I, key(d, dt.cast(F.col(V), v.dtype, d)).alias("x"))
    out = asof(values, edges, a.size + v.size, side == "right")
    return Array.of(out.select(I, F.col("_before").alias(V)), v.shape, I64)


def _few(edges) -> bool:
    """Whether edges come to the driver: those that are there already, and arrays of a bounded size."""
    from loomarray.operators.merging import LITERAL

    return not isinstance(edges, Array) or edges.size <= LITERAL


def digitize(x, bins, right: bool = False) -> Array:
    """The bin of each value; bins ascend or descend.

    Few bins, or bins of the driver, are searched by halves; those of a larger array are merged with the values.
    """
    from loomarray.operators.merging import found

    x = asarray(x)
    if not _few(bins):
        n = bins.size
        down = bool(bins[0].item() > bins[n - 1].item())
        place = searchsorted(bins, x, "left" if right else "right")
        return place.with_value(lambda c: F.lit(n).cast("long") - c, I64) if down else place
    edges = np.asarray(bins.numpy() if isinstance(bins, Array) else bins, float)
    n, down = len(edges), len(edges) > 1 and edges[0] > edges[-1]
    c = F.array(*map(F.lit, np.sort(edges).tolist())) if n else F.array().cast("array<double>")

    def f(v):
        v = v.cast("double")
        k = found(c, n, v, not right)
        return F.when(F.isnan(v), F.lit(0 if down else n)).otherwise(n - k if down else k).cast("long")

    return x.with_value(f, I64)


# ---- sets
def _values(a: Array, placed: bool = False) -> DataFrame:
    """Distinct values (column x) with their count and, where wanted, their first place."""
    v = F.col(V)
    if a.dtype.kind == "f":
        v = v + F.lit(0).cast(dt.spark_type(a.dtype))
    elif a.dtype.kind == "c":
        v = dt.cplx(v["re"] + F.lit(0.0), v["im"] + F.lit(0.0), a.dtype)
    if placed:
        return a.df.select(I, v.alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.min(I).alias("first"))
    return a.bag.select(v.alias("x")).groupBy("x").agg(F.count("*").alias("n"))


def _from_values(df: DataFrame, d: np.dtype) -> Array:
    out, n = numbered(df, key(d, F.col("x")), name="_r")
    return Array(out, F.col("_r"), F.col("x"), (n,), d)


def _packed(a: Array, axis: int) -> DataFrame:
    """Each slice across `axis`: its place `o` and its cells in order, `x`; one zero and one NaN."""
    (k,) = axes_of(axis, a.ndim)
    rest = [j for j in range(a.ndim) if j != k]
    cs = coords(F.col(I), a.shape)
    v = F.col(V)
    if a.dtype.kind == "f":
        v = v + F.lit(0).cast(dt.spark_type(a.dtype))
    elif a.dtype.kind == "c":
        v = dt.cplx(v["re"] + F.lit(0.0), v["im"] + F.lit(0.0), a.dtype)
    cells = a.df.select(cs[k].alias("o"), F.struct(ravel([cs[j] for j in rest], [a.shape[j] for j in rest]).alias("p"), v.alias("v")).alias("c"))
    return cells.groupBy("o").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["v"]).alias("x"))


def _unique_slices(a: Array, axis: int, return_index: bool, return_inverse: bool, return_counts: bool):
    """Distinct slices across an axis, in the order of their cells.

    A slice is one value of the plan, so it has to fit in a task; slices meet by their hash and are
    compared in full, and their places come from ranges of whole slices (`numbered`).
    """
    (k,) = axes_of(axis, a.ndim)
    rest = [j for j in range(a.ndim) if j != k]
    slices = _packed(a, k)
    sums = slices.groupBy("x").agg(F.count("*").alias("n"), F.min("o").alias("first"))
    values, n = numbered(sums, F.col("x"), name="_r")
    shape = tuple(n if j == k else s for j, s in enumerate(a.shape))
    within = coords(F.col("_p").cast("long"), [a.shape[j] for j in rest])
    at = [within[rest.index(j)] if j != k else F.col("_r") for j in range(a.ndim)]
    cells = values.select("_r", F.posexplode("x").alias("_p", V)).select(ravel(at, shape).alias(I), V)
    out = [Array.of(cells, shape, a.dtype)]
    if return_index:
        out.append(Array(values, F.col("_r"), F.col("first"), (n,), I64))
    if return_inverse:
        own = slices.select("o", F.col("x").alias("y"))
        out.append(Array.of(own.join(values.select("x", "_r"), F.col("x") == F.col("y")).select(F.col("o").alias(I), F.col("_r").alias(V)), (a.shape[k],), I64))
    if return_counts:
        out.append(Array(values, F.col("_r"), F.col("n"), (n,), I64))
    return out[0] if len(out) == 1 else tuple(out)


def unique(a, return_index: bool = False, return_inverse: bool = False, return_counts: bool = False, axis: int | None = None):
    """Distinct values in order, with the first place, the place among them, and the count of each; across an axis, distinct slices."""
    a = asarray(a)
    if axis is not None:
        return _unique_slices(a, axis, return_index, return_inverse, return_counts)
    values = _from_values(_values(a, return_index), a.dtype)
    out = [values]
    if return_index:
        out.append(Array(values.frame, values.index, F.col("first"), values.shape, I64))
    if return_inverse:
        v = F.col(V)
        if a.dtype.kind == "f":
            v = v + F.lit(0).cast(dt.spark_type(a.dtype))
        elif a.dtype.kind == "c":
            v = dt.cplx(v["re"] + F.lit(0.0), v["im"] + F.lit(0.0), a.dtype)
        own = a.df.select(I, v.alias("y"))
        at = values.frame.select("x", "_r")
        out.append(Array.of(own.join(at, F.col("x").eqNullSafe(F.col("y"))).select(I, F.col("_r").alias(V)), a.shape, I64))
    if return_counts:
        out.append(Array(values.frame, values.index, F.col("n"), values.shape, I64))
    return out[0] if len(out) == 1 else tuple(out)


def unique_values(a) -> Array:
    return unique(a)


def unique_counts(a):
    return unique(a, return_counts=True)


def unique_inverse(a):
    return unique(a, return_inverse=True)


def unique_all(a):
    return unique(a, True, True, True)


def _pair(a, b) -> tuple[Array, Array, np.dtype]:
    a, b = asarray(a), asarray(b)
    d = np.result_type(a.dtype, b.dtype)
    return a.astype(d), b.astype(d), d


def union1d(a, b) -> Array:
    a, b, d = _pair(a, b)
    return _from_values(_values(a).select("x").union(_values(b).select("x")).distinct(), d)


def _known(df: DataFrame, d: np.dtype) -> DataFrame:
    return df.where(~ew.is_nan(F.col("x"), d))


def intersect1d(a, b) -> Array:
    a, b, d = _pair(a, b)
    return _from_values(_known(_values(a), d).select("x").join(_values(b).select("x"), "x", "left_semi"), d)


def setdiff1d(a, b) -> Array:
    a, b, d = _pair(a, b)
    return _from_values(_values(a).select("x").join(_known(_values(b), d).select("x"), "x", "left_anti"), d)


def setxor1d(a, b) -> Array:
    a, b, d = _pair(a, b)
    x, y = _values(a).select("x"), _values(b).select("x")
    return _from_values(x.join(_known(y, d), "x", "left_anti").union(y.join(_known(x, d), "x", "left_anti")), d)


def isin(a, b, invert: bool = False) -> Array:
    a, b, d = _pair(a, b)
    there = _known(_values(b), d).select(F.col("x"), F.lit(True).alias("_in"))
    own = a.df.select(I, (F.col(V) + F.lit(0).cast(dt.spark_type(d)) if d.kind == "f" else F.col(V)).alias("x"))
    found = F.coalesce(F.col("_in"), F.lit(False))
    return Array.of(own.join(there, "x", "left").select(I, (~found if invert else found).alias(V)), a.shape, BOOL)


in1d = isin


def trim_zeros(a, trim: str = "fb") -> Array:
    from loomarray.operators.shape import moved

    a = asarray(a)
    r = a.df.where(dt.cast(F.col(V), a.dtype, BOOL)).agg(F.min(I), F.max(I)).first()
    if r[0] is None:
        return moved(a, (0,), lambda c: c, lambda c: F.lit(False))
    lo, hi = (r[0] if "f" in trim.lower() else 0), (r[1] + 1 if "b" in trim.lower() else a.size)
    return moved(a, (hi - lo,), lambda c: [c[0] - lo], lambda c: (c[0] >= lo) & (c[0] < hi))


# ---- counting
def bincount(x, weights=None, minlength: int = 0) -> Array:
    """How often each whole number from 0 occurs, or the sum of its weights."""
    from loomarray.cells import session

    x = asarray(x)
    if x.dtype.kind not in "iu" and x.dtype.kind != "b":
        raise TypeError("whole numbers only")
    low, high = x.bag.agg(F.min(V), F.max(V)).first()
    if low is not None and int(low) < 0:
        raise ValueError("'list' argument must have no negative elements")
    n = max(minlength, 0 if high is None else int(high) + 1)
    if weights is None:
        sums, d, zero = x.bag.groupBy(F.col(V).cast("long").alias("_k")).agg(F.count("*").alias("s")), I64, F.lit(0).cast("long")
    else:
        w = asarray(weights)
        both = mapped(lambda v, u: F.struct(v.cast("long").alias("k"), u.cast("double").alias("w")), F64, x, w)
        sums, d, zero = both.bag.groupBy(F.col(V)["k"].alias("_k")).agg(F.sum(F.col(V)["w"]).alias("s")), F64, F.lit(0.0)
    full = session().range(n).join(sums, F.col("id") == F.col("_k"), "left")
    return Array.of(full.select(F.col("id").alias(I), F.coalesce("s", zero).alias(V)), (n,), d)


def histogram_bin_edges(a, bins=10, range=None, weights=None) -> np.ndarray:  # noqa: A002
    """Bin edges, from a few figures of the data."""
    if not isinstance(bins, (str, int, np.integer)):
        return np.asarray(bins.numpy() if isinstance(bins, Array) else bins, float)
    a = asarray(a)
    v = dt.cast(F.col(V), a.dtype, F64)
    df = a.bag.select(v.alias("x"))
    if range is not None:
        df = df.where((F.col("x") >= range[0]) & (F.col("x") <= range[1]))
    n, lo, hi, sd, mean = df.agg(F.count("x"), F.min("x"), F.max("x"), F.stddev_pop("x"), F.avg("x")).first()
    low, high = (0.0, 1.0) if n == 0 and range is None else (lo, hi) if range is None else map(float, range)
    if not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError(f"autodetected range of [{low}, {high}] is not finite")
    if low == high:
        low, high = low - 0.5, high + 0.5
    if isinstance(bins, str):
        bins = _rule(bins, df, n, lo, hi, sd, mean, low, high, a.dtype) if n else 1
    return np.linspace(low, high, int(bins) + 1)


def _rule(name: str, df: DataFrame, n: int, lo: float, hi: float, sd: float, mean: float, low: float, high: float, d: np.dtype) -> int:
    """Number of bins by a rule's bin width."""
    ptp = hi - lo

    def fd():
        q = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)))).first()[0]
        return 2.0 * (q[1] - q[0]) * n ** (-1 / 3)

    def sturges():
        return ptp / (math.log2(n) + 1)

    def doane():
        if n > 2 and sd > 0:
            sg1 = math.sqrt(6.0 * (n - 2) / ((n + 1.0) * (n + 3)))
            g1 = df.agg(F.avg(F.pow((F.col("x") - mean) / sd, F.lit(3.0)))).first()[0]
            return ptp / (1.0 + math.log2(n) + math.log2(1.0 + abs(g1) / sg1))
        return 0.0

    def stone():
        upper, best, width = max(100, int(math.sqrt(n))), None, 0.0
        if ptp == 0:
            return 0.0
        for k in range_(1, upper + 1):
            counts = df.groupBy(F.least(F.floor((F.col("x") - lo) / (ptp / k)), F.lit(k - 1)).alias("b")).count()
            p2 = counts.agg(F.sum((F.col("count") / n) * (F.col("count") / n))).first()[0]
            h = ptp / k
            loss = (2 - (n + 1) * p2) / h
            if best is None or loss < best:
                best, width = loss, h
        return width

    rules = {"sqrt": lambda: ptp / math.sqrt(n), "rice": lambda: ptp / (2.0 * n ** (1 / 3)), "scott": lambda: (24.0 * math.pi**0.5 / n) ** (1 / 3) * sd, "fd": fd, "sturges": sturges, "doane": doane, "stone": stone}
    if name == "auto":
        wide = fd()
        width = min(max(wide, ptp / math.sqrt(n) / 2), sturges()) if wide else sturges()
    else:
        width = rules[name]()
    if width and d.kind in "iu" and width < 1:
        width = 1.0
    return max(1, math.ceil((high - low) / width)) if width else 1


range_ = range


def _bin(v: Column, edges: np.ndarray) -> Column:
    """The bin of a value, the last one closed; null outside."""
    c = F.array(*map(F.lit, edges.tolist()))
    n = len(edges) - 1
    even = n > 0 and np.allclose(np.diff(edges), edges[1] - edges[0], rtol=1e-12, atol=0)
    if even:  # by division, then put right against the edges themselves
        k = F.floor((v - float(edges[0])) / float((edges[-1] - edges[0]) / n)).cast("int")
        k = F.least(F.greatest(k, F.lit(0)), F.lit(n - 1))
        k = F.when(v < F.get(c, k), k - 1).when((v >= F.get(c, k + 1)) & (k < n - 1), k + 1).otherwise(k)
    else:
        from loomarray.operators.merging import found

        k = F.least(found(c, n + 1, v, True) - 1, F.lit(n - 1))
    return F.when((v >= float(edges[0])) & (v <= float(edges[-1])) & ~F.isnan(v), k)


def histogram(a, bins=10, range=None, density: bool = False, weights=None):  # noqa: A002
    counts, edges = histogramdd([a], [bins], None if range is None else [range], density, weights)
    return counts, edges[0]


def histogram2d(x, y, bins=10, range=None, density: bool = False, weights=None):  # noqa: A002
    if np.ndim(bins) == 0 or isinstance(bins, str):
        bins = [bins, bins]
    elif len(bins) != 2:
        bins = [bins, bins]
    counts, edges = histogramdd([x, y], bins, range, density, weights)
    return counts, edges[0], edges[1]


def histogramdd(sample, bins=10, range=None, density: bool = False, weights=None):  # noqa: A002
    """Counts over a grid of bins; `sample` is a matrix with a column, or a list with an array, for each dimension."""
    from loomarray.cells import session

    if not isinstance(sample, (list, tuple)):
        from loomarray.operators.shape import unstack

        m = asarray(sample)
        sample = unstack(m.reshaped((m.size, 1)) if m.ndim == 1 else m, 1)
    xs = [asarray(x) for x in sample]
    xs = [x.reshaped((x.size,)) for x in xs]
    bins = [bins] * len(xs) if np.ndim(bins) == 0 or isinstance(bins, str) else list(bins)
    ranges = [None] * len(xs) if range is None else list(range)
    edges = [histogram_bin_edges(x, b, r) for x, b, r in zip(xs, bins, ranges, strict=True)]
    shape = tuple(len(e) - 1 for e in edges)
    kinds = [x.dtype for x in xs]
    w = [asarray(weights).reshaped((xs[0].size,))] if weights is not None else []

    def cell(*v):
        at = [_bin(dt.cast(c, k, F64), e) for c, k, e in zip(v, kinds, edges, strict=False)]
        return F.struct(ravel([c.cast("long") for c in at], shape).alias("k"), (v[-1].cast("double") if w else F.lit(1)).alias("w"))

    df = mapped(cell, F64, *xs, *w).bag.select(F.col(V)["k"].alias("_k"), F.col(V)["w"].alias("w")).where(F.col("_k").isNotNull())
    sums = df.groupBy("_k").agg((F.sum("w") if w else F.count("*")).alias("s"))
    n = math.prod(shape)
    d = F64 if w or density else I64
    full = session().range(n).join(sums, F.col("id") == F.col("_k"), "left").select(F.col("id").alias(I), F.coalesce("s", F.lit(0)).cast(dt.spark_type(d)).alias(V))
    out = Array.of(full, shape, d)
    if density:
        total = df.agg(F.sum("w")).first()[0]
        volume = np.ones(shape)
        for k, e in enumerate(edges):
            volume = volume * np.diff(e).reshape([-1 if j == k else 1 for j in range_(len(shape))])
        out = mapped(lambda c, u: c / (u * float(total)), F64, out, asarray(volume))
    return out, edges


def cov(m, y=None, rowvar: bool = True, bias: bool = False, ddof=None) -> Array:
    """Covariances of variables (rows): products of centred values, summed by a join on the observation."""
    from loomarray.cells import elementwise
    from loomarray.operators.linalg import matmul
    from loomarray.operators.reductions import mean
    from loomarray.operators.shape import atleast_2d, concatenate, transpose

    x = atleast_2d(m)
    if not rowvar and x.shape[0] != 1:
        x = transpose(x)
    if y is not None:
        other = atleast_2d(y)
        x = concatenate([x, other if rowvar or other.shape[0] == 1 else transpose(other)], 0)
    x = x.astype(np.result_type(x.dtype, F64))
    ddof = (0 if bias else 1) if ddof is None else ddof
    centred = elementwise("subtract", x, mean(x, axis=1, keepdims=True))
    out = elementwise("divide", matmul(centred, elementwise("conjugate", transpose(centred))), float(x.shape[1] - ddof))
    return out.reshaped(()) if out.size == 1 else out


def corrcoef(x, y=None, rowvar: bool = True) -> Array:
    from loomarray.cells import elementwise
    from loomarray.operators.linalg import diagonal

    c = cov(x, y, rowvar)
    if c.ndim == 0:
        return elementwise("divide", c, c)
    c = c.cached()
    d = elementwise("sqrt", elementwise("real", diagonal(c)))
    out = elementwise("divide", elementwise("divide", c, d.reshaped((d.size, 1))), d.reshaped((1, d.size)))
    return out if out.dtype.kind == "c" else out.with_value(lambda v: F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))), F64)


del gather
