"""The 14 element types, how Spark holds them, and how they convert.

Types are NumPy dtypes; promotion is NumPy's own, asked for on the driver.  Values are held as

    bool                    boolean
    int8 .. int64           byte, short, int, long
    uint8, uint16, uint32   short, int, long (the next wider signed type)
    uint64                  decimal(20, 0)
    float16, float32        float (float16 rounded to half precision by arithmetic)
    float64                 double
    complex64, complex128   struct<re, im> of float, double
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("float64", "float32", "float16", "complex128", "complex64", "int64", "int32", "int16", "int8", "uint64", "uint32", "uint16", "uint8", "bool")

_HELD = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}


def dtype(x) -> np.dtype:
    d = np.dtype(x)
    if d.name not in NAMES:
        raise TypeError(f"no such element type: {d}")
    return d


def part(d: np.dtype) -> np.dtype:
    """The type of a complex type's parts; any other type itself."""
    return np.dtype("float32" if d.itemsize == 8 else "float64") if d.kind == "c" else d


def spark_type(d: np.dtype) -> T.DataType:
    if d.kind == "c":
        p = _HELD[part(d).name]
        return T.StructType([T.StructField("re", p), T.StructField("im", p)])
    return _HELD[d.name]


def of_spark(t: T.DataType) -> np.dtype:
    """The element type of a table's column."""
    if isinstance(t, T.StructType) and t.names == ["re", "im"]:
        return np.dtype("complex64" if isinstance(t["re"].dataType, T.FloatType) else "complex128")
    for name in ("bool", "int8", "int16", "int32", "int64", "float32", "float64"):
        if _HELD[name] == t:
            return np.dtype(name)
    if isinstance(t, T.DecimalType) and t.scale == 0:
        return np.dtype("uint64")
    raise TypeError(f"no element type for {t.simpleString()}")


def lit(value, d: np.dtype) -> Column:
    """A constant of an element type."""
    if d.kind == "c":
        z = complex(value)
        return cplx(F.lit(z.real), F.lit(z.imag), d)
    if d.kind == "b":
        return F.lit(bool(value))
    if d.kind == "f":
        return F.lit(float(value)).cast(_HELD[d.name])
    return F.lit(str(int(value))).cast("decimal(20,0)") if d.name == "uint64" else F.lit(int(value)).cast(_HELD[d.name])


def cplx(re: Column, im: Column, d: np.dtype = np.dtype("complex128")) -> Column:
    t = _HELD[part(d).name]
    return F.struct(re.cast(t).alias("re"), im.cast(t).alias("im"))


def half(x: Column) -> Column:
    """The nearest half-precision value (ties to even), as a float."""
    a = F.abs(x.cast("double"))
    exponent = F.greatest(F.floor(F.log2(F.when((a > 0) & (a < math.inf), a).otherwise(1.0))), F.lit(-14).cast("long"))
    unit = F.pow(F.lit(2.0), (exponent - 10).cast("double"))
    near = F.rint(x / unit) * unit
    out = F.when(F.isnan(x) | (a == math.inf) | (a == 0), x).when(F.abs(near) >= 65520.0, F.signum(x) * F.lit(math.inf)).otherwise(near)
    return out.cast("float")


def wrap(x: Column, d: np.dtype) -> Column:
    """An integral long or decimal brought into an integer type's range, modulo its size."""
    bits = 8 * d.itemsize
    low = 0 if d.kind == "u" else -(1 << (bits - 1))
    if bits == 64:
        m = F.lit(str(1 << 64)).cast("decimal(38,0)")
        shifted = x.cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")
        r = ((shifted % m) + m) % m + F.lit(str(low)).cast("decimal(38,0)")
        return r.cast(_HELD[d.name])
    size = 1 << bits
    return (F.pmod(x - low, F.lit(size)) + low).cast(_HELD[d.name])


def cast(x: Column, old: np.dtype, new: np.dtype) -> Column:
    """An element type's conversion as NumPy's astype: integers wrap, floats truncate, NaN to int is 0."""
    if old == new:
        return x
    if new.kind == "c":
        return cplx(x["re"], x["im"], new) if old.kind == "c" else cplx(cast(x, old, part(new)), F.lit(0.0), new)
    if old.kind == "c":
        if new.kind == "b":
            return (x["re"] != 0) | (x["im"] != 0)
        return cast(x["re"], part(old), new)
    if new.kind == "b":
        return x != F.lit(0)
    if new.kind == "f":
        y = x.cast("int").cast("double") if old.kind == "b" else x.cast("double")
        return half(y) if new.name == "float16" else y.cast(_HELD[new.name])
    if old.kind == "b":
        return x.cast("int").cast(_HELD[new.name])
    if old.kind == "f":
        if new.name == "uint64":
            return wrap(F.when(F.abs(x) < 1.8446744073709552e19, x.cast("double")).otherwise(0.0).cast("decimal(38,0)"), new)
        whole = F.when(F.abs(x) < 9.223372036854775e18, x.cast("double")).otherwise(0.0).cast("long")
        return whole if new.itemsize == 8 else wrap(whole, new)
    if np.can_cast(old, new):
        return x.cast(_HELD[new.name])
    if old.name == "uint64" or new.name == "uint64":
        return wrap(x.cast("decimal(38,0)"), new) if 8 * new.itemsize == 64 else wrap((x % F.lit(str(1 << 32)).cast("decimal(38,0)")).cast("long"), new)
    return wrap(x.cast("long"), new)
