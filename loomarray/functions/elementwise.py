"""Element-wise functions as Column expressions, with NumPy's rules for NaN, infinity, zero and overflow.

`KERNELS[name](loop, *columns)` gives the result's Column; `loop` is the NumPy dtype of the inputs
after promotion (`resolve`).  Everything here is a projection: no join, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomarray.dtypes import cast, cplx, half, lit, part, spark_type, wrap

NAN, INF = math.nan, math.inf
KERNELS: dict[str, Callable] = {}
ALIASES: dict[str, str] = {}


def kernel(*names: str):
    def put(f):
        KERNELS[names[0]] = f
        for n in names[1:]:
            KERNELS[n] = f
            ALIASES[n] = names[0]
        return f

    return put


def minus_zero(x: Column) -> Column:
    """Whether a zero is negative; only sensible where x is 0."""
    return F.startswith(x.cast("double").cast("string"), F.lit("-"))


def is_negative(x: Column) -> Column:
    """The sign bit of a float (NaN counts as positive)."""
    return F.when(F.isnan(x), False).when(x == 0, minus_zero(x)).otherwise(x < 0)


def is_nan(x: Column, d: np.dtype) -> Column:
    if d.kind == "f":
        return F.isnan(x)
    return F.isnan(x["re"]) | F.isnan(x["im"]) if d.kind == "c" else F.lit(False)


def shaped(x: Column, d: np.dtype) -> Column:
    """A double brought to a float type's precision."""
    return half(x) if d.name == "float16" else x.cast(spark_type(d))


def divided(a: Column, b: Column) -> Column:
    """a / b of doubles, with infinities and NaN where b is 0."""
    a, b = a.cast("double"), b.cast("double")
    sign = F.when(is_negative(a) != minus_zero(b), -INF).otherwise(INF)
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), NAN).otherwise(sign)


# ---- complex helpers: pairs (re, im) of doubles
def parts(z: Column) -> tuple[Column, Column]:
    return z["re"].cast("double"), z["im"].cast("double")


def c_mul(a, b):
    (x, y), (u, v) = a, b
    return x * u - y * v, x * v + y * u


def c_div(a, b):
    """By the larger part of the divisor (no overflow on the way)."""
    (x, y), (u, v) = a, b
    big = F.abs(u) >= F.abs(v)
    r = F.when(big, divided(v, u)).otherwise(divided(u, v))
    den = F.when(big, u + v * r).otherwise(u * r + v)
    return divided(F.when(big, x + y * r).otherwise(x * r + y), den), divided(F.when(big, y - x * r).otherwise(y * r - x), den)


def c_exp(z):
    x, y = z
    m = F.exp(x)
    return m * F.cos(y), F.when(y == 0, y).otherwise(m * F.sin(y))


def c_log(z):
    x, y = z
    turn = F.when(is_negative(x), math.pi).otherwise(0.0)
    return safe_log(F.hypot(x, y)), F.when((y == 0) & ~F.isnan(x), F.when(minus_zero(y), -turn).otherwise(turn)).otherwise(F.atan2(y, x))


def c_sqrt(z):
    x, y = z
    m = F.hypot(x, y)
    t = F.sqrt((m + F.abs(x)) / 2)
    re = F.when(x >= 0, t).otherwise(F.when(t == 0, 0.0).otherwise(F.try_divide(F.abs(y), 2 * t)))
    im = F.when(x >= 0, F.when(t == 0, y).otherwise(F.try_divide(y, 2 * t))).otherwise(F.when(is_negative(y), -t).otherwise(t))
    return re, im


def i_times(z):
    return -z[1], z[0]


def complex_of(f):
    return lambda loop, *z: cplx(*f(*(parts(x) for x in z)), loop)


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, -INF).otherwise(NAN)


# ---- arithmetic
def _wide(loop: np.dtype, f, narrow) -> Callable:
    """Integer arithmetic: native where it can't overflow, else by decimals, and wrapped."""

    def run(a, b):
        if loop.itemsize < 8:
            return wrap(f(a.cast("long"), b.cast("long")), loop)
        exact = wrap(f(a.cast("decimal(38,0)"), b.cast("decimal(38,0)")), loop)
        return exact if loop.kind == "u" else F.coalesce(narrow(a, b), exact)

    return run


def _arithmetic(name: str, f, narrow, on_complex):
    def run(loop, a, b):
        if loop.kind == "c":
            return cplx(*on_complex(parts(a), parts(b)), loop)
        if loop.kind == "f":
            return shaped(f(a.cast("double"), b.cast("double")), loop)
        if loop.kind == "b":
            return (a | b) if name == "add" else (a & b)
        return _wide(loop, f, narrow)(a, b)

    KERNELS[name] = run


_arithmetic("add", lambda a, b: a + b, F.try_add, lambda a, b: (a[0] + b[0], a[1] + b[1]))
_arithmetic("subtract", lambda a, b: a - b, F.try_subtract, lambda a, b: (a[0] - b[0], a[1] - b[1]))


@kernel("multiply")
def multiply(loop, a, b):
    if loop.kind == "c":
        return cplx(*c_mul(parts(a), parts(b)), loop)
    if loop.kind == "f":
        return shaped(a.cast("double") * b.cast("double"), loop)
    if loop.kind == "b":
        return a & b
    if loop.itemsize < 8:
        if loop.itemsize < 4:
            return wrap(a.cast("long") * b.cast("long"), loop)
        # two 32-bit factors fit a long when signed; unsigned ones fit a decimal
        product = a.cast("long") * b.cast("long") if loop.kind == "i" else (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) % F.lit(1 << 32)
        return wrap(product.cast("long"), loop)
    # by halves, so that no product leaves 38 digits
    low = F.lit(str(1 << 32)).cast("decimal(20,0)")
    x, y = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    y0 = ((y % low) + low) % low
    y1 = ((y - y0) / low).cast("decimal(20,0)")
    m64 = F.lit(str(1 << 64)).cast("decimal(38,0)")
    high = ((x * y1.cast("decimal(11,0)")).cast("decimal(38,0)") % m64 % low.cast("decimal(38,0)")).cast("decimal(12,0)") * low.cast("decimal(12,0)")
    exact = wrap((x * y0.cast("decimal(11,0)")).cast("decimal(38,0)") + high.cast("decimal(38,0)"), loop)
    return exact if loop.kind == "u" else F.coalesce(F.try_multiply(a, b), exact)


@kernel("divide", "true_divide")
def divide(loop, a, b):
    return cplx(*c_div(parts(a), parts(b)), loop) if loop.kind == "c" else shaped(divided(a, b), loop)


def _floor(x: Column) -> Column:
    """floor as a double; keeps NaN, infinities, the sign of zero and what is too large for a long."""
    return F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0) | (x == 0), x).otherwise(F.floor(F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), 0.0).otherwise(x)).cast("double"))


def _mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    r = F.try_mod(a, b) if hasattr(F, "try_mod") else a % b
    moved = F.when((r != 0) & ((r < 0) != (b < 0)), r + b).when(r == 0, F.when(is_negative(b), F.lit(-0.0)).otherwise(F.lit(0.0))).otherwise(r)
    return F.when(F.isnan(a) | F.isnan(b) | (F.abs(a) == math.inf) | (b == 0), NAN).when(F.abs(b) == math.inf, F.when((a == 0) | ((a < 0) == (b < 0)), a).otherwise(b)).otherwise(moved)


def _int_mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0)).otherwise(((F.try_mod(a, b)) + b) % F.when(b == 0, 1).otherwise(b))


@kernel("floor_divide")
def floor_divide(loop, a, b):
    if loop.kind == "f":
        a, b = a.cast("double"), b.cast("double")
        m = _mod(a, b)
        exact = divided(a - m, b)
        near = _floor(exact)
        near = F.when(exact - near > 0.5, near + 1.0).otherwise(near)
        far = F.when((a == 0) | (is_negative(a) == is_negative(b)), 0.0).otherwise(-1.0)
        out = F.when(b == 0, divided(a, b)).when((F.abs(b) == math.inf) & (F.abs(a) != math.inf) & ~F.isnan(a), far).when(exact == 0, F.when(is_negative(a) != is_negative(b), F.lit(-0.0)).otherwise(0.0)).otherwise(near)
        return shaped(F.when(F.isnan(m) & (b != 0), F.when(F.isnan(a) | F.isnan(b) | (F.abs(a) == math.inf), NAN).otherwise(out)).otherwise(out), loop)
    wide = "decimal(38,0)" if loop.itemsize == 8 else "long"
    a, b = a.cast(wide), b.cast(wide)
    one = F.when(b == 0, F.lit(1).cast(wide)).otherwise(b)
    m = ((a % one) + one) % one
    q = ((a - m) / one).cast(wide) if wide != "long" else F.expr("0").cast("long") + F.floor((a - m) / one).cast("long")
    return wrap(F.when(b == 0, F.lit(0).cast(wide)).otherwise(q), loop)


@kernel("mod", "remainder")
def mod(loop, a, b):
    if loop.kind == "f":
        return shaped(_mod(a.cast("double"), b.cast("double")), loop)
    wide = "decimal(38,0)" if loop.itemsize == 8 else "long"
    a, b = a.cast(wide), b.cast(wide)
    one = F.when(b == 0, F.lit(1).cast(wide)).otherwise(b)
    return F.when(b == 0, F.lit(0).cast(wide)).otherwise(((a % one) + one) % one).cast(spark_type(loop))


@kernel("fmod")
def fmod(loop, a, b):
    if loop.kind == "f":
        a, b = a.cast("double"), b.cast("double")
        safe = F.when(b == 0, 1.0).otherwise(b)
        out = F.when(F.isnan(a) | F.isnan(b) | (F.abs(a) == math.inf) | (b == 0), NAN).when(F.abs(b) == math.inf, a).otherwise(a % safe)
        return shaped(F.when((out == 0) & is_negative(a), F.lit(-0.0)).otherwise(out), loop)
    one = F.when(b == 0, F.lit(1).cast(spark_type(loop))).otherwise(b)
    return F.when(b == 0, F.lit(0)).otherwise(a % one).cast(spark_type(loop))


@kernel("power", "pow")
def power(loop, a, b):
    if loop.kind == "c":
        z, w = parts(a), parts(b)
        by_log = c_exp(c_mul(w, c_log(z)))
        zero = (z[0] == 0) & (z[1] == 0)
        none = (w[0] == 0) & (w[1] == 0)
        square = (w[0] == 2) & (w[1] == 0)
        whole = c_mul(z, z)
        return cplx(F.when(none, 1.0).when(zero, F.when(w[0] > 0, 0.0).otherwise(NAN)).when(square, whole[0]).otherwise(by_log[0]), F.when(none | zero, F.when(zero & ~none & (w[0] <= 0), NAN).otherwise(0.0)).when(square, whole[1]).otherwise(by_log[1]), loop)
    if loop.kind == "f":
        a, b = a.cast("double"), b.cast("double")
        return shaped(F.when((b == 0) | (a == 1), 1.0).when((a == -1) & (F.abs(b) == math.inf), 1.0).otherwise(F.pow(a, b)), loop)
    # squares of the base for each bit of the exponent, wrapped on the way
    e = cast(b, loop, np.dtype("int64"))
    t = spark_type(loop)
    bits = F.sequence(F.lit(0), F.lit(8 * loop.itemsize - 1 - (loop.kind == "i")))
    start = F.struct(lit(1, loop).alias("out"), a.cast(t).alias("base"))

    def step(s, bit):
        out = F.when(F.getbit(e, bit) == 1, multiply(loop, s["out"], s["base"])).otherwise(s["out"])
        return F.struct(out.cast(t).alias("out"), multiply(loop, s["base"], s["base"]).cast(t).alias("base"))

    return F.aggregate(bits, start, step)["out"]


@kernel("float_power")
def float_power(loop, a, b):
    return power(loop, a, b)


@kernel("square")
def square(loop, a):
    return multiply(loop, a, a)


@kernel("negative")
def negative(loop, a):
    if loop.kind == "c":
        return cplx(-a["re"], -a["im"], loop)
    return -a if loop.kind == "f" else wrap(-a.cast("decimal(38,0)" if loop.itemsize == 8 else "long"), loop)


@kernel("positive")
def positive(loop, a):
    return a


@kernel("absolute", "abs", "fabs")
def absolute(loop, a):
    if loop.kind == "c":
        return F.hypot(*parts(a)).cast(spark_type(part(loop)))
    if loop.kind == "f":
        return F.abs(a)
    return a if loop.kind in "bu" else wrap(F.abs(a.cast("decimal(38,0)" if loop.itemsize == 8 else "long")), loop)


@kernel("sign")
def sign(loop, a):
    if loop.kind == "c":
        m = F.hypot(*parts(a))
        return cplx(F.when(m == 0, 0.0).otherwise(F.try_divide(parts(a)[0], m)), F.when(m == 0, 0.0).otherwise(F.try_divide(parts(a)[1], m)), loop)
    return F.when(is_nan(a, loop), a).when(a > 0, lit(1, loop)).when(a < 0, lit(-1, loop) if loop.kind != "u" else lit(0, loop)).otherwise(lit(0, loop))


@kernel("reciprocal")
def reciprocal(loop, a):
    if loop.kind == "c":
        return cplx(*c_div((F.lit(1.0), F.lit(0.0)), parts(a)), loop)
    if loop.kind == "f":
        return shaped(divided(F.lit(1.0), a), loop)
    zero = lit(np.iinfo(loop).min if loop.name in ("int32", "int64") else 0, loop)
    return F.when(a == 1, lit(1, loop)).when(a == -1, lit(-1, loop) if loop.kind == "i" else lit(0, loop)).when(a == 0, zero).otherwise(lit(0, loop))


@kernel("heaviside")
def heaviside(loop, a, b):
    return F.when(F.isnan(a), a).when(a < 0, lit(0, loop)).when(a == 0, b).otherwise(lit(1, loop))


@kernel("maximum")
def maximum(loop, a, b):
    if loop.kind == "c":
        return F.when(is_nan(a, loop), a).when(is_nan(b, loop), b).otherwise(F.when(a >= b, a).otherwise(b))
    return F.greatest(a, b) if loop.kind != "b" else a | b


@kernel("minimum")
def minimum(loop, a, b):
    if loop.kind == "b":
        return a & b
    return F.when(is_nan(a, loop), a).when(is_nan(b, loop), b).otherwise(F.when(a <= b, a).otherwise(b))


@kernel("fmax")
def fmax(loop, a, b):
    return F.when(is_nan(a, loop), b).when(is_nan(b, loop), a).otherwise(maximum(loop, a, b))


@kernel("fmin")
def fmin(loop, a, b):
    return F.when(is_nan(a, loop), b).when(is_nan(b, loop), a).otherwise(minimum(loop, a, b))


@kernel("gcd")
def gcd(loop, a, b):
    """Euclid's steps over an array of their number's bound, cut short at 0."""
    wide = "decimal(20,0)" if loop.itemsize == 8 else "long"
    steps = F.sequence(F.lit(1), F.lit(int(8 * loop.itemsize * 1.45) + 2))
    start = F.struct(F.abs(a.cast(wide)).alias("x"), F.abs(b.cast(wide)).alias("y"))
    out = F.aggregate(steps, start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1).cast(wide)).otherwise(s["y"])).cast(wide).alias("y"))))
    return wrap(out["x"], loop)


@kernel("lcm")
def lcm(loop, a, b):
    wide = "decimal(38,0)" if loop.itemsize >= 4 else "long"
    g = gcd(loop, a, b).cast(wide)
    x, y = F.abs(a.cast(wide)), F.abs(b.cast(wide))
    return wrap(F.when(g == 0, F.lit(0).cast(wide)).otherwise(F.floor(x / F.when(g == 0, F.lit(1).cast(wide)).otherwise(g)).cast(wide) * y), loop)


# ---- roots, exponentials, logarithms, trigonometry
def real_or_complex(name: str, real, on_complex=None):
    def run(loop, a):
        if loop.kind == "c":
            return cplx(*on_complex(parts(a)), loop)
        return shaped(real(a.cast("double")), loop)

    KERNELS[name] = run


def c_sin(z):
    x, y = z
    return F.sin(x) * F.cosh(y), F.cos(x) * F.sinh(y)


def c_cos(z):
    x, y = z
    return F.cos(x) * F.cosh(y), -(F.sin(x) * F.sinh(y))


def c_sinh(z):
    x, y = z
    return F.sinh(x) * F.cos(y), F.cosh(x) * F.sin(y)


def c_cosh(z):
    x, y = z
    return F.cosh(x) * F.cos(y), F.sinh(x) * F.sin(y)


def c_asinh(z):
    """log(z + sqrt(z^2 + 1)), for the half plane where that loses nothing, and odd."""
    x, y = z
    flip = is_negative(x)
    s = F.when(flip, -1.0).otherwise(1.0)
    u, v = x * s, y * s
    q = c_sqrt((u * u - v * v + 1, 2 * u * v))
    re, im = c_log((u + q[0], v + q[1]))
    return re * s, im * s


def c_asin(z):
    x, y = z
    re, im = c_asinh((-y, x))
    return im, -re


def c_acos(z):
    re, im = c_asin(z)
    return F.lit(math.pi / 2) - re, -im


def c_acosh(z):
    x, y = z
    a, b = c_sqrt((x - 1, y)), c_sqrt((x + 1, y))
    p = c_mul(a, b)
    return c_log((x + p[0], y + p[1]))


def c_atanh(z):
    x, y = z
    a, b = c_log((1 + x, y)), c_log((1 - x, -y))
    return (a[0] - b[0]) / 2, (a[1] - b[1]) / 2


def c_atan(z):
    x, y = z
    re, im = c_atanh((-y, x))
    return im, -re


def scaled_log(k):
    return lambda z: tuple(p / math.log(k) for p in c_log(z))


def c_log1p(z):
    return c_log((z[0] + 1, z[1]))


def c_expm1(z):
    x, y = z
    s = F.sin(y / 2)
    return F.expm1(x) * F.cos(y) - 2 * s * s, F.exp(x) * F.sin(y)


def _asinh(x):
    a = F.abs(x)
    r = F.when(a == math.inf, a).when(a < 1e-4, a - a * a * a / 6).when(a > 1e8, safe_log(a) + math.log(2)).otherwise(F.log1p(a + a * a / (1 + F.sqrt(a * a + 1))))
    return F.when(F.isnan(x) | (x == 0), x).otherwise(F.signum(x) * r)


real_or_complex("sqrt", F.sqrt, c_sqrt)
real_or_complex("cbrt", F.cbrt)
real_or_complex("exp", F.exp, c_exp)
real_or_complex("exp2", lambda x: F.pow(F.lit(2.0), x), lambda z: c_exp((z[0] * math.log(2), z[1] * math.log(2))))
real_or_complex("expm1", F.expm1, c_expm1)
real_or_complex("log", safe_log, c_log)
real_or_complex("log2", lambda x: F.when(x > 0, F.log2(x)).when(x == 0, -INF).otherwise(NAN), scaled_log(2))
real_or_complex("log10", lambda x: F.when(x > 0, F.log10(x)).when(x == 0, -INF).otherwise(NAN), scaled_log(10))
real_or_complex("log1p", lambda x: F.when(x > -1, F.log1p(x)).when(x == -1, -INF).otherwise(NAN), c_log1p)
real_or_complex("sin", F.sin, c_sin)
real_or_complex("cos", F.cos, c_cos)
real_or_complex("tan", F.tan, lambda z: c_div(c_sin(z), c_cos(z)))
real_or_complex("arcsin", F.asin, c_asin)
real_or_complex("arccos", F.acos, c_acos)
real_or_complex("arctan", F.atan, c_atan)
real_or_complex("sinh", F.sinh, c_sinh)
real_or_complex("cosh", F.cosh, c_cosh)
real_or_complex("tanh", F.tanh, lambda z: c_div(c_sinh(z), c_cosh(z)))
real_or_complex("arcsinh", _asinh, c_asinh)
real_or_complex("arccosh", lambda x: F.when(x < 1, NAN).when(x > 1e8, safe_log(x) + math.log(2)).otherwise(F.log1p((x - 1) + F.sqrt((x - 1) * (x + 1)))), c_acosh)
real_or_complex("arctanh", lambda x: F.when(x == 1, INF).when(x == -1, -INF).when(F.abs(x) > 1, NAN).when(x == 0, x).otherwise(F.atanh(x)), c_atanh)
real_or_complex("degrees", lambda x: x * (180.0 / math.pi))
real_or_complex("radians", lambda x: x * (math.pi / 180.0))
for _new, _old in {"asin": "arcsin", "acos": "arccos", "atan": "arctan", "asinh": "arcsinh", "acosh": "arccosh", "atanh": "arctanh", "rad2deg": "degrees", "deg2rad": "radians"}.items():
    KERNELS[_new] = KERNELS[_old]
    ALIASES[_new] = _old


@kernel("arctan2", "atan2")
def arctan2(loop, a, b):
    a, b = a.cast("double"), b.cast("double")
    turn = F.when(is_negative(b), math.pi).otherwise(0.0)
    zero = F.when(minus_zero(a), -turn).otherwise(turn)
    return shaped(F.when((a == 0) & ~F.isnan(b), zero).otherwise(F.atan2(a, b)), loop)


@kernel("hypot")
def hypot(loop, a, b):
    return shaped(F.hypot(a.cast("double"), b.cast("double")), loop)


def _logadd(loop, a, b, log1p, exp, unit):
    a, b = a.cast("double"), b.cast("double")
    high, d = F.greatest(a, b), -F.abs(a - b)
    return shaped(F.when(a == b, a + unit).when(F.isnan(a) | F.isnan(b), NAN).otherwise(high + log1p(exp(d))), loop)


@kernel("logaddexp")
def logaddexp(loop, a, b):
    return _logadd(loop, a, b, F.log1p, F.exp, math.log(2))


@kernel("logaddexp2")
def logaddexp2(loop, a, b):
    return _logadd(loop, a, b, lambda x: F.log1p(x) / math.log(2), lambda x: F.pow(F.lit(2.0), x), 1.0)


@kernel("sinc")
def sinc(loop, a):
    if loop.kind == "c":
        z = tuple(p * math.pi for p in parts(a))
        none = (z[0] == 0) & (z[1] == 0)
        re, im = c_div(c_sin(z), z)
        return cplx(F.when(none, 1.0).otherwise(re), F.when(none, 0.0).otherwise(im), loop)
    y = a.cast("double") * math.pi
    return shaped(F.when(a == 0, 1.0).otherwise(F.try_divide(F.sin(y), y)), loop)


#: Coefficients of the Chebyshev series of exp(-x) I0(x), on [0, 8] and (after 1/x) beyond (Cephes).
I0_NEAR = (
    -4.41534164647933937950e-18, 3.33079451882223809783e-17, -2.43127984654795469359e-16, 1.71539128555513303061e-15, -1.16853328779934516808e-14,
    7.67618549860493561688e-14, -4.85644678311192946090e-13, 2.95505266312963983461e-12, -1.72682629144155570723e-11, 9.67580903537323691224e-11,
    -5.18979560163526290666e-10, 2.65982372468238665035e-9, -1.30002500998624804212e-8, 6.04699502254191894932e-8, -2.67079385394061173391e-7,
    1.11738753912010371815e-6, -4.41673835845875056359e-6, 1.64484480707288970893e-5, -5.75419501008210370398e-5, 1.88502885095841655729e-4,
    -5.76375574538582365885e-4, 1.63947561694133579842e-3, -4.32430999505057594430e-3, 1.05464603945949983183e-2, -2.37374148058994688156e-2,
    4.93052842396707084878e-2, -9.49010970480476444210e-2, 1.71620901522208775349e-1, -3.04682672343198398683e-1, 6.76795274409476084995e-1,
)
I0_FAR = (
    -7.23318048787475395456e-18, -4.83050448594418207126e-18, 4.46562142029675999901e-17, 3.46122286769746109310e-17, -2.82762398051658348494e-16,
    -3.42548561967721913462e-16, 1.77256013305652638360e-15, 3.81168066935262242075e-15, -9.55484669882830764870e-15, -4.15056934728722208663e-14,
    1.54008621752140982691e-14, 3.85277838274214270114e-13, 7.18012445138366623367e-13, -1.79417853150680611778e-12, -1.32158118404477131188e-11,
    -3.14991652796324136454e-11, 1.18891471078464383424e-11, 4.94060238822496958910e-10, 3.39623202570838634515e-9, 2.26666899049817806459e-8,
    2.04891858946906374183e-7, 2.89137052083475648297e-6, 6.88975834691682398426e-5, 3.36911647825569408990e-3, 8.04490411014108831608e-1,
)


def _chebyshev(x: Column, coefficients) -> Column:
    start = F.struct(F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"), F.lit(0.0).alias("b2"))
    out = F.aggregate(F.array(*map(F.lit, coefficients)), start, lambda s, c: F.struct((x * s["b0"] - s["b1"] + c).alias("b0"), s["b0"].alias("b1"), s["b1"].alias("b2")))
    return 0.5 * (out["b0"] - out["b2"])


@kernel("i0")
def i0(loop, a):
    x = F.abs(a.cast("double"))
    safe = F.when(x > 8, x).otherwise(8.0)
    return shaped(F.when(F.isnan(a), NAN).when(x <= 8, F.exp(x) * _chebyshev(x / 2 - 2, I0_NEAR)).otherwise(F.exp(x) * _chebyshev(32.0 / safe - 2, I0_FAR) / F.sqrt(safe)), loop)


# ---- rounding
def _whole(loop, a, f):
    if loop.kind in "iub":
        return a
    return f(a.cast("double")).cast(spark_type(loop))


@kernel("floor")
def floor(loop, a):
    return _whole(loop, a, _floor)


def _ceil(x):
    return -_floor(-x)


@kernel("ceil")
def ceil(loop, a):
    return _whole(loop, a, _ceil)


@kernel("trunc", "fix")
def trunc(loop, a):
    return _whole(loop, a, lambda x: F.when(is_negative(x), _ceil(x)).otherwise(_floor(x)))


@kernel("rint")
def rint(loop, a):
    return cplx(*(F.rint(p) for p in parts(a)), loop) if loop.kind == "c" else _whole(loop, a, F.rint)


def around(loop: np.dtype, a: Column, decimals: int = 0) -> Column:
    """Half to even, at `decimals` places (before the point where negative)."""
    if loop.kind == "c":
        return cplx(*(around(np.dtype("float64"), p, decimals) for p in parts(a)), loop)
    if loop.kind == "b":
        return around(np.dtype("float16"), cast(a, loop, np.dtype("float16")), decimals)
    if loop.kind in "iu":
        if decimals >= 0:
            return a
        unit = 10.0**-decimals
        return F.rint(a.cast("double") / unit).cast("decimal(38,0)").__mul__(F.lit(str(int(unit))).cast("decimal(19,0)")).cast(spark_type(loop)) if loop.itemsize == 8 else (F.rint(a.cast("double") / unit) * unit).cast("long").cast(spark_type(loop))
    unit = 10.0 ** abs(decimals)
    x = a.cast("double")
    near = F.rint(x * unit) / unit if decimals >= 0 else F.rint(x / unit) * unit
    return shaped(F.when(F.isnan(x) | (F.abs(x) == math.inf), x).otherwise(near), loop)


# ---- complex
@kernel("real")
def real(loop, a):
    return a["re"] if loop.kind == "c" else a


@kernel("imag")
def imag(loop, a):
    return a["im"] if loop.kind == "c" else lit(0, loop)


@kernel("conjugate", "conj")
def conjugate(loop, a):
    return cplx(a["re"], -a["im"], loop) if loop.kind == "c" else a


@kernel("angle")
def angle(loop, a, deg: bool = False):
    if loop.kind == "c":
        out = arctan2(part(loop), a["im"], a["re"])
    else:
        out = F.when(is_nan(a, loop), NAN).when(is_negative(a.cast("double")) if loop.kind == "f" else a.cast("double") < 0, math.pi).otherwise(0.0)
    out = out.cast("double") * (180 / math.pi) if deg else out
    return out.cast(spark_type(part(loop))) if loop.kind in "cf" else out.cast("double")


# ---- bits
@kernel("bitwise_and")
def bitwise_and(loop, a, b):
    return a & b if loop.kind == "b" else _bits(loop, a, b, lambda x, y: x.bitwiseAND(y))


@kernel("bitwise_or")
def bitwise_or(loop, a, b):
    return a | b if loop.kind == "b" else _bits(loop, a, b, lambda x, y: x.bitwiseOR(y))


@kernel("bitwise_xor")
def bitwise_xor(loop, a, b):
    return a != b if loop.kind == "b" else _bits(loop, a, b, lambda x, y: x.bitwiseXOR(y))


I64 = np.dtype("int64")


def _bits(loop, a, b, f):
    if loop.name != "uint64":
        return f(a, b).cast(spark_type(loop))
    return wrap(f(cast(a, loop, I64), cast(b, loop, I64)), loop)


@kernel("bitwise_not", "invert", "bitwise_invert")
def bitwise_not(loop, a):
    if loop.kind == "b":
        return ~a
    return F.bitwise_not(a) if loop.kind == "i" else wrap(-a.cast("decimal(38,0)") - 1 if loop.itemsize == 8 else -a.cast("long") - 1, loop)


@kernel("left_shift", "bitwise_left_shift")
def left_shift(loop, a, b):
    bits = 8 * loop.itemsize
    n = b.cast("int")
    x = cast(a, loop, I64)
    moved = F.call_function("shiftleft", x, F.when((n >= 0) & (n < bits), n).otherwise(0))
    out = wrap(moved, loop) if loop.itemsize < 8 or loop.kind == "u" else moved
    return F.when((n < 0) | (n >= bits), lit(0, loop)).otherwise(out)


@kernel("right_shift", "bitwise_right_shift")
def right_shift(loop, a, b):
    bits = 8 * loop.itemsize
    n = b.cast("int")
    fits = (n >= 0) & (n < bits)
    if loop.name == "uint64":
        moved = F.floor(a / F.pow(F.lit(2.0), F.when(fits, n).otherwise(0)).cast("decimal(20,0)")).cast("decimal(20,0)")
    else:
        moved = F.call_function("shiftright", a.cast("long"), F.when(fits, n).otherwise(0)).cast(spark_type(loop))
    return F.when(fits, moved).otherwise(F.when(a < 0, lit(-1, loop) if loop.kind == "i" else lit(0, loop)).otherwise(lit(0, loop)))


@kernel("bitwise_count")
def bitwise_count(loop, a):
    if loop.name == "uint64":
        return F.bit_count(cast(a, loop, I64)).cast("short")
    least = a == lit(np.iinfo(loop).min, loop) if loop.kind == "i" else F.lit(False)
    return F.when(least, 1).otherwise(F.bit_count(F.abs(F.when(least, 0).otherwise(a.cast("long"))))).cast("short")


# ---- logic
def _truth(loop, a):
    return cast(a, loop, np.dtype("bool"))


KERNELS["logical_and"] = lambda loop, a, b: _truth(loop, a) & _truth(loop, b)
KERNELS["logical_or"] = lambda loop, a, b: _truth(loop, a) | _truth(loop, b)
KERNELS["logical_xor"] = lambda loop, a, b: _truth(loop, a) != _truth(loop, b)
KERNELS["logical_not"] = lambda loop, a: ~_truth(loop, a)


def _compare(name: str, f):
    def run(loop, a, b):
        if loop.kind == "b":
            a, b = a.cast("int"), b.cast("int")
        bad = is_nan(a, loop) | is_nan(b, loop)
        if loop.kind == "c" and name not in ("equal", "not_equal"):
            a, b = (F.struct(*parts(x)) for x in (a, b))
        return (~bad & f(a, b)) if name != "not_equal" else (bad | f(a, b))

    KERNELS[name] = run


_compare("equal", lambda a, b: a == b)
_compare("not_equal", lambda a, b: a != b)
_compare("greater", lambda a, b: a > b)
_compare("greater_equal", lambda a, b: a >= b)
_compare("less", lambda a, b: a < b)
_compare("less_equal", lambda a, b: a <= b)


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = a.cast("double"), b.cast("double")
    bad = F.isnan(a) | F.isnan(b)
    endless = (F.abs(a) == math.inf) | (F.abs(b) == math.inf)
    out = F.when(endless, a == b).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))
    return F.when(bad, F.isnan(a) & F.isnan(b) if equal_nan else F.lit(False)).otherwise(out)


def _any_part(f):
    return lambda loop, a: (f(a["re"]) | f(a["im"])) if loop.kind == "c" else f(a) if loop.kind == "f" else F.lit(False)


KERNELS["isnan"] = _any_part(F.isnan)
KERNELS["isinf"] = _any_part(lambda x: F.abs(x) == math.inf)
KERNELS["isfinite"] = lambda loop, a: ~(KERNELS["isnan"](loop, a) | KERNELS["isinf"](loop, a))
KERNELS["isposinf"] = lambda loop, a: (a == math.inf) if loop.kind == "f" else F.lit(False)
KERNELS["isneginf"] = lambda loop, a: (a == -math.inf) if loop.kind == "f" else F.lit(False)
KERNELS["isnat"] = lambda loop, a: F.lit(False)
KERNELS["iscomplex"] = lambda loop, a: (a["im"] != 0) if loop.kind == "c" else F.lit(False)
KERNELS["isreal"] = lambda loop, a: (a["im"] == 0) if loop.kind == "c" else F.lit(True)


@kernel("signbit")
def signbit(loop, a):
    return is_negative(a) if loop.kind == "f" else a.cast("double") < 0


@kernel("copysign")
def copysign(loop, a, b):
    return F.when(is_negative(b), -F.abs(a)).otherwise(F.abs(a)).cast(spark_type(loop))


def _ulp(x: Column, digits: int, least: int) -> Column:
    """Distance from |x| to the next larger float."""
    a = F.abs(x)
    exponent = F.floor(F.log2(F.when((a > 0) & (a < math.inf), a).otherwise(1.0))).cast("double")
    # log2 may round to the next power
    exponent = F.when(F.pow(F.lit(2.0), exponent) > a, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= a, exponent + 1).otherwise(exponent)
    return F.when(a < 2.0 ** (least + digits), F.pow(F.lit(2.0), F.lit(float(least)))).otherwise(F.pow(F.lit(2.0), exponent - digits))


#: Bits of the fraction, exponent of the least subnormal.
SCALE = {"float16": (10, -24), "float32": (23, -149), "float64": (52, -1074)}


@kernel("spacing")
def spacing(loop, a):
    x = a.cast("double")
    u = _ulp(x, *SCALE[loop.name])
    if loop.name == "float16":  # the distance to the next value upwards
        power_ = F.abs(x) == F.pow(F.lit(2.0), F.rint(F.log2(F.when(x == 0, 1.0).otherwise(F.abs(x)))))
        u = F.when(is_negative(x) & power_ & (F.abs(x) > 2.0**-14), u / 2).otherwise(u)
    else:
        u = F.when(is_negative(x), -u).otherwise(u)
    return F.when(F.isnan(x) | (F.abs(x) == math.inf), NAN).otherwise(u).cast(spark_type(loop))


@kernel("nextafter")
def nextafter(loop, a, b):
    x, y = a.cast("double"), b.cast("double")
    digits, least = SCALE[loop.name]
    u = _ulp(x, digits, least)
    # towards zero, a power of two is near its smaller neighbour
    down = F.when((F.abs(x) > 2.0 ** (least + digits)) & (F.abs(x) == F.pow(F.lit(2.0), F.rint(F.log2(F.when(x == 0, 1.0).otherwise(F.abs(x)))))), u / 2).otherwise(u)
    up = y > x
    away = up == (x > 0)
    top = F.when(up, -INF).otherwise(INF)
    biggest = F.lit(float(np.finfo(loop).max))
    moved = F.when(x == 0, F.when(up, F.lit(2.0**least)).otherwise(F.lit(-(2.0**least)))).when(F.abs(x) == math.inf, F.when(x == top, F.signum(x) * biggest).otherwise(x)).otherwise(x + F.when(up, F.when(away, u).otherwise(down)).otherwise(-F.when(away, u).otherwise(down)))
    over = F.abs(moved) > biggest
    moved = F.when(over, F.signum(moved) * INF).otherwise(moved)
    return F.when(F.isnan(x) | F.isnan(y), NAN).when(x == y, y).otherwise(moved).cast(spark_type(loop))


def frexp(x: Column) -> tuple[Column, Column]:
    """Mantissa in [0.5, 1) and exponent, as Columns."""
    x = x.cast("double")
    a = F.abs(x)
    e = F.floor(F.log2(F.when((a > 0) & (a < math.inf), a).otherwise(1.0))).cast("int") + 1
    half = lambda e: (e / 2).cast("int")
    # one factor after the other: their product is over the largest double where x is subnormal
    scaled = lambda v, e: v * F.pow(F.lit(2.0), -half(e).cast("double")) * F.pow(F.lit(2.0), -(e - half(e)).cast("double"))
    m = scaled(a, e)
    e = F.when(m >= 1, e + 1).when(m < 0.5, e - 1).otherwise(e)
    plain = (a > 0) & (a < math.inf)
    return F.when(plain, scaled(x, e)).otherwise(x), F.when(plain, e).otherwise(0).cast("int")


@kernel("ldexp")
def ldexp(loop, a, b):
    n = b.cast("int")
    h = (n / 2).cast("int")
    return shaped(a.cast("double") * F.pow(F.lit(2.0), h.cast("double")) * F.pow(F.lit(2.0), (n - h).cast("double")), loop)


def modf(x: Column) -> tuple[Column, Column]:
    """Fraction and whole part, both with the sign of x."""
    whole = trunc(np.dtype("float64"), x)
    part_ = F.when(F.abs(x) == math.inf, 0.0).otherwise(x - whole)
    return F.when(F.isnan(x), x).otherwise(F.when(is_negative(x), -F.abs(part_)).otherwise(F.abs(part_))), whole


def clip(loop: np.dtype, a: Column, low: Column | None, high: Column | None) -> Column:
    out = a if low is None else maximum(loop, a, low)
    return out if high is None else minimum(loop, out, high)


def nan_to_num(loop: np.dtype, a: Column, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Column:
    if loop.kind == "c":
        return cplx(*(nan_to_num(part(loop), a[p], nan, posinf, neginf) for p in ("re", "im")), loop)
    if loop.kind != "f":
        return a
    most = float(np.finfo(loop).max)
    return F.when(F.isnan(a), lit(nan, loop)).when(a == math.inf, lit(most if posinf is None else posinf, loop)).when(a == -math.inf, lit(-most if neginf is None else neginf, loop)).otherwise(a)


#: Functions whose result type is not that of a NumPy ufunc of the same name.
_BOOL = {"isnat", "iscomplex", "isreal", "isposinf", "isneginf"}
#: NumPy's name where ours is the reference's.
_NUMPY = {"fix": "trunc", "abs": "absolute"}


def resolve(name: str, *kinds) -> tuple[list[np.dtype], np.dtype]:
    """(input types after promotion, result type), as NumPy has them; Python scalars are weak."""
    base = _NUMPY.get(name, name)
    known = [k for k in kinds if isinstance(k, np.dtype)]
    if name in _BOOL:
        return list(kinds), np.dtype("bool")
    if name in ("real", "imag", "angle", "i0", "sinc", "float_power"):
        d = np.result_type(*(k if isinstance(k, np.dtype) else k() for k in kinds))
        if name in ("real", "imag"):
            return [d], part(d)
        if name == "angle":
            return [d], part(d) if d.kind == "c" else np.arctan2.resolve_dtypes((d, d, None))[-1]
        to = np.result_type(d, np.float64) if name == "float_power" or d.kind not in "fc" else d
        return [to] * len(kinds), to
    f = getattr(np, base)
    if name in ("frexp", "modf"):
        got = f.resolve_dtypes((*kinds, None, None))
        return list(got[: len(kinds)]), got[len(kinds)]
    if not known and kinds:
        kinds = tuple(np.dtype(k) for k in kinds)
    got = f.resolve_dtypes((*kinds, None))
    return list(got[:-1]), got[-1]


def apply(name: str, columns: list[Column], kinds: list[np.dtype]) -> tuple[Column, np.dtype]:
    """A function of columns of given element types: the result and its type."""
    to, out = resolve(name, *kinds)
    loop = to[0]
    given = [cast(c, k if isinstance(k, np.dtype) else np.dtype(k), t) for c, k, t in zip(columns, kinds, to, strict=True)]
    return KERNELS[name](loop, *given), out


def column(name: str):
    """A plain function of double columns, for tables: `column("hypot")(a, b)`."""
    return lambda *cs: apply(name, list(cs), [np.dtype("float64")] * len(cs))[0]
