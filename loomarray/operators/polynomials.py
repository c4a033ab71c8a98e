"""Polynomials, highest power first.  Coefficients are few and live on the driver; values are a projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomarray import dtypes as dt
from loomarray.cells import Array, asarray, elementwise, mapped
from loomarray.functions import elementwise as ew


def _few(x) -> np.ndarray:
    return np.atleast_1d(x.numpy() if isinstance(x, Array) else np.asarray(x))


def _out(x) -> Array:
    return asarray(np.asarray(x))


def poly(roots) -> Array:
    return _out(np.poly(_few(roots)))


def polyadd(a, b) -> Array:
    return _out(np.polyadd(_few(a), _few(b)))


def polysub(a, b) -> Array:
    return _out(np.polysub(_few(a), _few(b)))


def polymul(a, b) -> Array:
    return _out(np.polymul(_few(a), _few(b)))


def polydiv(a, b) -> tuple[Array, Array]:
    q, r = np.polydiv(_few(a), _few(b))
    return _out(q), _out(r)


def polyder(p, m: int = 1) -> Array:
    return _out(np.polyder(_few(p), m))


def polyint(p, m: int = 1, k=None) -> Array:
    return _out(np.polyint(_few(p), m, k))


def roots(p) -> Array:
    return _out(np.roots(_few(p)))


def polyval(p, x) -> Array:
    """Horner's scheme as one expression."""
    c, x = _few(p), asarray(x)
    d = np.result_type(c.dtype, x.dtype)

    def f(v):
        v = dt.cast(v, x.dtype, d)
        out = dt.lit(0, d)
        for k in c.tolist():
            out = ew.apply("add", [ew.multiply(d, out, v), dt.lit(k, d)], [d, d])[0]
        return out

    return x.with_value(f, d)


def polyfit(x, y, deg: int, w=None) -> Array:
    """Least squares by the normal equations: one pass sums the powers, whatever the number of points.

    Abscissas are centred and scaled first, so that the system stays well conditioned.
    """
    x, y = asarray(x).astype(np.float64), asarray(y).astype(np.float64)
    weights = [asarray(w).astype(np.float64)] if w is not None else []
    df = mapped(lambda *v: F.struct(*(c.alias(n) for c, n in zip(v, "xyw", strict=False))), np.float64, x, y, *weights).df.select("v.*")
    n, mean, spread = df.agg(F.count("*"), F.avg("x"), F.stddev_pop("x")).first()
    spread = spread or 1.0
    t = (F.col("x") - mean) / spread
    ww = F.col("w") * F.col("w") if weights else F.lit(1.0)
    powers = [F.lit(1.0)]
    for _ in range(2 * deg):
        powers.append(powers[-1] * t)
    sums = df.agg(*(F.sum(ww * p) for p in powers), *(F.sum(ww * powers[k] * F.col("y")) for k in range(deg + 1))).first()
    gram = np.array([[sums[i + j] for j in range(deg + 1)] for i in range(deg + 1)])
    c = np.linalg.lstsq(gram, np.array(sums[2 * deg + 1 :]), rcond=None)[0]
    # back to powers of x
    shift = np.poly1d([1 / spread, -mean / spread])
    out = np.poly1d([0.0])
    for k in range(deg, -1, -1):
        out = out * shift + c[k]
    full = np.zeros(deg + 1)
    full[deg - out.order :] = out.coeffs
    return _out(full)


del elementwise
