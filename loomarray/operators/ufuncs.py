"""Element-wise functions of arrays (arithmetic, trigonometry, rounding, bits, logic, complex)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomarray import dtypes as dt
from loomarray.cells import Array, asarray, elementwise, mapped
from loomarray.functions import elementwise as ew


def _function(name: str):
    def f(*operands):
        return elementwise(name, *operands)

    f.__name__ = f.__qualname__ = name
    f.__doc__ = f"Element-wise {name}, with broadcasting and NumPy's type rules."
    return f


SPECIAL = {"angle", "fix"}
for _name in ew.KERNELS:
    if _name not in SPECIAL:
        globals()[_name] = _function(_name)


def angle(z, deg: bool = False) -> Array:
    """Argument of complex numbers, in radians or degrees."""
    return elementwise("angle", z, deg=deg)


def fix(x) -> Array:
    """Rounded towards zero."""
    return elementwise("trunc", x)


def around(a, decimals: int = 0) -> Array:
    """Half to even, at a number of decimals."""
    a = asarray(a)
    out = np.dtype("float16") if a.dtype.kind == "b" else a.dtype
    return a.with_value(lambda v: ew.around(a.dtype, v, decimals), out)


round = around  # noqa: A001


def divmod(a, b) -> tuple[Array, Array]:  # noqa: A001
    return elementwise("floor_divide", a, b), elementwise("mod", a, b)


def frexp(a) -> tuple[Array, Array]:
    """Mantissa and exponent."""
    a = asarray(a)
    to, out = ew.resolve("frexp", a.dtype)
    pair = [a.with_value(lambda v, k=k: ew.frexp(dt.cast(v, a.dtype, to[0]))[k].cast(dt.spark_type(t)), t) for k, t in enumerate((out, np.dtype("int32")))]
    return pair[0], pair[1]


def modf(a) -> tuple[Array, Array]:
    """Fraction and whole part."""
    a = asarray(a)
    to, out = ew.resolve("modf", a.dtype)
    pair = [a.with_value(lambda v, k=k: ew.modf(dt.cast(v, a.dtype, to[0]).cast("double"))[k].cast(dt.spark_type(out)), out) for k in (0, 1)]
    return pair[0], pair[1]


def clip(a, a_min=None, a_max=None) -> Array:
    a = asarray(a)
    bounds = [None if x is None else x if isinstance(x, Array) else asarray(np.asarray(x)) for x in (a_min, a_max)]
    weak = [x for x in (a_min, a_max) if isinstance(x, (int, float)) and not isinstance(x, bool)]
    out = np.result_type(a.dtype, *(b.dtype for b, x in zip(bounds, (a_min, a_max), strict=True) if b is not None and x not in weak), *weak) if weak else np.result_type(a.dtype, *(b.dtype for b in bounds if b is not None))
    given = [x for x in bounds if x is not None]

    def f(v, *rest):
        rest = iter(dt.cast(c, b.dtype, out) for c, b in zip(rest, given, strict=True))
        low, high = (next(rest) if b is not None else None for b in bounds)
        return ew.clip(out, dt.cast(v, a.dtype, out), low, high)

    return mapped(f, out, a, *given)


def nan_to_num(a, nan: float = 0.0, posinf=None, neginf=None) -> Array:
    a = asarray(a)
    return a.with_value(lambda v: ew.nan_to_num(a.dtype, v, nan, posinf, neginf), a.dtype)


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Array:
    """|a - b| <= atol + rtol |b|; equal infinities are close."""
    return mapped(lambda x, y: ew.isclose(x, y, rtol, atol, equal_nan), np.bool_, asarray(a), asarray(b))


def allclose(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> bool:
    from loomarray.operators.reductions import all as all_

    return bool(all_(isclose(a, b, rtol, atol, equal_nan)).item())


def iscomplexobj(x) -> bool:
    return asarray(x).dtype.kind == "c"


def isrealobj(x) -> bool:
    return not iscomplexobj(x)


def real_if_close(a, tol: float = 100) -> Array:
    """The real part, if every imaginary part is within `tol` machine epsilons (or `tol` itself, up to 1)."""
    from loomarray.operators.reductions import all as all_

    a = asarray(a)
    if a.dtype.kind != "c":
        return a
    if tol > 1:
        tol = float(np.finfo(dt.part(a.dtype)).eps) * tol
    small = a.with_value(lambda v: F.abs(v["im"].cast("double")) < tol, np.bool_)
    return elementwise("real", a) if all_(small).item() else a


def isfortran(a) -> bool:
    return False


def isscalar(x) -> bool:
    return np.isscalar(x)


def iterable(x) -> bool:
    return x.ndim > 0 if isinstance(x, Array) else np.iterable(x)


def isdtype(dtype, kind) -> bool:
    return np.isdtype(np.dtype(dtype), kind)


def promote_types(a, b) -> np.dtype:
    return np.promote_types(a, b)


def interp(x, xp, fp, left=None, right=None, period=None) -> Array:
    """Linear interpolation between the points (xp, fp); xp ascends.  With a `period`, points and values wrap around.

    Few points, or points of the driver, are searched by halves; those of larger arrays are merged with
    the values (`merging.asof`), and none of them comes to the driver.
    """
    from loomarray.operators.sorting import _few

    x = asarray(x)
    if period is not None and float(period) == 0:
        raise ValueError("period must be a non-zero value")
    if not (_few(xp) and _few(fp)):
        return _merged(x, asarray(xp), asarray(fp), left, right, period)
    knots, values = (np.asarray(p.numpy() if isinstance(p, Array) else p, float) for p in (xp, fp))
    if period is not None:
        period, left, right = math.fabs(period), None, None
        order = np.argsort(knots % period, kind="stable")
        knots, values = (knots % period)[order], values[order]
        knots, values = np.concatenate([knots[-1:] - period, knots, knots[:1] + period]), np.concatenate([values[-1:], values, values[:1]])
        x = elementwise("mod", x, period)
    from loomarray.operators.merging import found

    n = len(knots)
    k, y = (F.array(*map(F.lit, a.tolist())) for a in (knots, values))
    low = float(values[0]) if left is None else float(left)
    high = float(values[-1]) if right is None else float(right)

    def f(v):
        v = v.cast("double")
        at = F.greatest(F.least(found(k, n, v, True), F.lit(n - 1)), F.lit(1)).cast("int")  # points up to v; 1 .. n - 1 inside
        x0, x1, y0, y1 = (F.get(c, i) for c, i in ((k, at - 1), (k, F.least(at, F.lit(n - 1))), (y, at - 1), (y, F.least(at, F.lit(n - 1)))))
        return _between(v, x0, y0, x1, y1, low, high, float(knots[0]), float(knots[-1]), float(values[-1]))

    return x.with_value(f, np.float64)


def _between(v, x0, y0, x1, y1, low, high, first, last, final) -> Column:
    inside = y0 + F.coalesce(F.try_divide(y1 - y0, x1 - x0), F.lit(0.0)) * (v - x0)
    return F.when(F.isnan(v), v).when(v < first, low).when(v > last, high).when(v == last, final).otherwise(F.when(v == x0, y0).otherwise(inside))


def _merged(x: Array, xp: Array, fp: Array, left, right, period) -> Array:
    """`interp` of points that are spread over the cluster: each value meets the points next to it."""
    from loomarray.cells import I, V, mapped
    from loomarray.operators.merging import asof

    if xp.size != fp.size:
        raise ValueError("fp and xp are not of the same length")
    if period is not None:
        period, left, right = math.fabs(period), None, None
        x, xp = elementwise("mod", x, period), elementwise("mod", xp, period)
    both = mapped(lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")), np.float64, xp, fp)
    points = both.bag.select(F.col(V)["x"].alias("x"), F.col(V)["y"].alias("y"))
    ends = points.agg(F.min(F.struct("x", "y")), F.max(F.struct("x", "y"))).first()
    (x_low, y_low), (x_high, y_high) = ends
    if period is not None:
        from loomarray.cells import session

        wrapped = [(x_high - period, y_high), (x_low + period, y_low)]
        points = points.unionByName(session().createDataFrame(wrapped, "x double, y double"))
        (x_low, y_low), (x_high, y_high) = wrapped
    values = x.df.select(I, (F.col(V).cast("double") + 0.0).alias("x"))
    out = asof(values, points, x.size + xp.size, True, sides=True)
    low, high = (float(d if given is None else given) for d, given in ((y_low, left), (y_high, right)))
    v, p, q = F.col("x"), F.col("_prev"), F.coalesce("_next", "_prev")
    return Array.of(out.select(I, _between(v, p["x"], p["y"], q["x"], q["y"], low, high, x_low, x_high, y_high).alias(V)), x.shape, np.float64)


def packbits(a, axis=None, bitorder: str = "big") -> Array:
    """Eight truth values to a byte along an axis (flattened without one)."""
    from loomarray.cells import I, V, axes_of, coords, ravel

    a = asarray(a)
    if axis is None:
        a, axis = a.reshaped((a.size,)), 0
    (axis,) = axes_of(axis, a.ndim)
    shape = (*a.shape[:axis], -(-a.shape[axis] // 8), *a.shape[axis + 1 :])
    cs = coords(F.col(I), a.shape)
    bit = (cs[axis] % 8).cast("int")
    power = F.call_function("shiftleft", F.lit(1), (7 - bit) if bitorder == "big" else bit)
    out = [*cs[:axis], F.call_function("div", cs[axis], F.lit(8)), *cs[axis + 1 :]]
    df = a.df.select(ravel(out, shape).alias("_o"), F.when(dt.cast(F.col(V), a.dtype, np.dtype("bool")), power).otherwise(0).alias(V))
    return Array.of(df.groupBy("_o").agg(F.sum(V).cast("short").alias(V)).withColumnRenamed("_o", I), shape, np.uint8)


def unpackbits(a, axis=None, count=None, bitorder: str = "big") -> Array:
    """The bits of bytes along an axis."""
    from loomarray.cells import axes_of, gather_bits

    a = asarray(a)
    if axis is None:
        a, axis = a.reshaped((a.size,)), 0
    (axis,) = axes_of(axis, a.ndim)
    return gather_bits(a, axis, count, bitorder)


def unwrap(p, discont=None, axis: int = -1, period: float = 2 * np.pi) -> Array:
    """Steps of more than half a period along an axis become their complement."""
    from loomarray.operators.scans import cumsum, shifted

    p = asarray(p)
    p = p if p.dtype.kind == "f" else p.astype(np.float64)
    jump = period / 2 if discont is None else max(discont, period / 2)
    frame, cell, before, first = shifted(p, axis, -1)
    d = cell.cast("double") - before.cast("double")
    m = ew._mod(d + period / 2, F.lit(float(period))) - period / 2
    m = F.when((m == -period / 2) & (d > 0), period / 2).otherwise(m)
    fix_ = F.when(first | (F.abs(d) < jump), 0.0).otherwise(m - d)
    correction = Array(frame, F.col("i"), F.coalesce(fix_, F.lit(0.0)), p.shape, np.float64)
    return elementwise("add", p, cumsum(correction, axis=axis)).astype(p.dtype)
