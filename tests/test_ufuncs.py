"""Element-wise functions against NumPy: edge values, all integer types, complex numbers."""

import inspect
import warnings

import numpy as np
import pytest

from loomarray.cells import asarray, local
from loomarray.functions.elementwise import KERNELS
from loomarray.operators import ufuncs as u

warnings.simplefilter("ignore")
E = np.array([np.nan, np.inf, -np.inf, -0.0, 0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 1e308, 5e-324, 3.7, -7.0, 1.0, -1.0, 8.5])
C = np.array([1 + 2j, -1.5 + 0.5j, 0.3 - 0.7j, -2 - 3j, 2 + 0j, 0.1 + 0.2j])
H = np.array([0.5, 1.5, -2.25, 3.0, 100.0], np.float16)
INTS = {d: np.array([np.iinfo(d).min, np.iinfo(d).min + 1, 0, 1, 2, 7, np.iinfo(d).max - 1, np.iinfo(d).max, *((-1, -7) if d[0] == "i" else (9, 11))], d) for d in ("int8", "int64", "uint32")}
UNARY = sorted(n for n in KERNELS if (len(inspect.signature(KERNELS[n]).parameters) == 2 or n == "angle") and n != "isnat")
BINARY = sorted(n for n in KERNELS if n not in UNARY and n != "isnat")


def close(got, expected):
    g, e = got.numpy(), np.asarray(expected)
    assert g.dtype == e.dtype
    if e.dtype.kind not in "fc":
        assert (g == e).all()
        return
    rtol = {2: 2e-3, 4: 1e-5}.get(e.dtype.itemsize, 1e-5 if e.dtype == np.complex64 else 1e-9)
    ok = np.isclose(g, e, rtol=rtol, atol=1e-12, equal_nan=True)
    assert ok.all(), [(x, y) for x, y, o in zip(g, e, ok, strict=True) if not o][:4]


def numpy_function(name):
    return getattr(np, {"fix": "trunc"}.get(name, name))


@pytest.mark.parametrize("name", UNARY)
def test_unary(spark, name):
    f = numpy_function(name)
    for x in (E, C, H if name != "sinc" else E, *INTS.values()):
        if x.dtype.kind in "iu" and name in ("exp", "exp2", "expm1", "sinh", "cosh"):
            x = x[2:6]
        try:
            expected = f(x)
        except TypeError:
            continue
        close(getattr(u, name)(asarray(x)), expected)


@pytest.mark.parametrize("name", BINARY)
def test_binary(spark, name):
    f = numpy_function(name)
    x, y = (z.ravel() for z in np.meshgrid(E, E))
    cases = [(x, y), (np.repeat(C, 6), np.tile(C, 6)), *(tuple(z.ravel() for z in np.meshgrid(v, v)) for v in INTS.values())]
    if name == "ldexp":
        cases = [(E, np.arange(len(E), dtype=np.int32) - 5)]
    for x, y in cases:
        if x.dtype.kind in "iu" and name in ("power", "pow", "float_power"):
            y = (np.abs(y.astype(object)) % 60).astype(x.dtype)
        if x.dtype.kind in "iu" and "shift" in name:
            y = (np.arange(len(x)) % 70).astype(x.dtype)
        try:
            expected = f(x, y)
        except (TypeError, ValueError):
            continue
        close(getattr(u, name)(local(x), local(y)), expected)


def test_projection_only(spark):
    """Functions of columns of one table need no join, no shuffle and no Python."""
    from loomarray.cells import from_columns

    df = spark.createDataFrame([(k, float(k), 2.0 * k) for k in range(10)], "k long, a double, b double")
    a, b = from_columns(df, ["a", "b"], ["k"])
    out = u.hypot(a * 2 + 1, b - a)
    plan = out.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
    assert np.allclose(out.numpy(), np.hypot(np.arange(10.0) * 2 + 1, np.arange(10.0)))


def vectors(spark):
    from loomarray.cells import from_vectors

    x = np.array([[0.0, -0.0, 0.5, 1.0, -3.7, 8.0], [np.inf, -np.inf, np.nan, 5e-324, 1e308, -0.25], [2.0**-1022, 2.0**-1074 * 3, np.nextafter(8.0, 0), np.nextafter(8.0, 9), -(2.0**52), 0.1]])
    return x, from_vectors(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k long, x array<double>"), "k", "x", x.shape[1])


def test_frexp_of_vectors(spark):
    """Vectors of a table are handed through `transform`, which counts a function's parameters."""
    x, a = vectors(spark)
    for got, expected in zip(u.frexp(a), np.frexp(x), strict=True):
        assert got._vectors is not None
        np.testing.assert_array_equal(got.numpy(), expected)
        assert got.dtype == expected.dtype


def test_modf_of_vectors(spark):
    x, a = vectors(spark)
    for got, expected in zip(u.modf(a), np.modf(x), strict=True):
        assert got._vectors is not None
        np.testing.assert_array_equal(got.numpy(), expected)
        np.testing.assert_array_equal(np.signbit(got.numpy()), np.signbit(expected))
