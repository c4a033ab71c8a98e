"""Convolution of two long lines: blocks of one meet blocks of the other, and what they make is added up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, div
from loomarray.operators.dense import _in, arrow

#: Cells of a block.  Products of two blocks' 16-bit parts are exact in floating-point transforms up to this size.
BLOCK = 1 << 16
#: Kernels up to this length slide over a block, without a transform.
SHORT = 512
#: Pieces of the result that one task adds up.
FAN = 32


def working(d: np.dtype) -> np.dtype:
    """What a type's cells are held as in blocks."""
    return np.dtype({"f": np.float64, "c": np.complex128}.get(d.kind, np.int64))


def blocks(a: Array, place: Callable[[Column], Column], size: int, name: str) -> DataFrame:
    """One row a block of `size` cells of a line whose cell i stands at `place(i)`: its number, and its bytes `b`."""
    d = a.dtype
    held = working(d)
    at = place(F.col(I))

    def run(table: pa.Table) -> pa.Table:
        x = np.zeros(size, held)
        x[table["p"].to_numpy()] = _in(table[V], d).astype(held) if d.name != "uint64" else _in(table[V], d).view(np.int64)
        return pa.table({name: table[name][:1], "b": pa.array([x.tobytes()], pa.binary())})

    return a.df.select(div(at, size).alias(name), (at % size).alias("p"), V).groupBy(name).applyInArrow(run, f"{name} long, b binary")


def transformed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = 1 << (len(x) + len(y) - 2).bit_length()
    if x.dtype.kind == "c":
        return np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(y, n))[: len(x) + len(y) - 1]
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y, n), n)[: len(x) + len(y) - 1]


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The convolution of whole numbers modulo 2^64.

    Both are split into signed parts of 16 bits.  Of two parts the transform's error stays under a
    half: about 2^-53 times three bits a level times the norms, of which each is at most 2^15 times
    the root of BLOCK.
    """

    def parts(v):
        out, v = [], v.copy()
        for _ in range(4):
            low = ((v & 0xFFFF) ^ 0x8000) - 0x8000
            out.append(low)
            v = (v - low) >> 16
            if not v.any():
                break
        return out

    total = np.zeros(len(x) + len(y) - 1, np.int64)
    ys = parts(y)
    for i, p in enumerate(parts(x)):
        for j, q in enumerate(ys):
            if i + j < 4:
                total += np.rint(transformed(p.astype(float), q.astype(float))).astype(np.int64) << (16 * (i + j))
    return total


def together(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The convolution of two blocks."""
    if min(len(x), len(y)) <= SHORT:
        return np.convolve(x, y)
    if x.dtype.kind == "i":
        return exact(x, y)
    odd_x, odd_y = ~np.isfinite(x), ~np.isfinite(y)
    if not odd_x.any() and not odd_y.any():
        return transformed(x, y)
    if odd_x.sum() + odd_y.sum() > SHORT:
        return np.convolve(x, y)
    # inf and NaN reach the cells that they meet, not the whole block
    out = transformed(np.where(odd_x, 0, x), np.where(odd_y, 0, y))
    with np.errstate(invalid="ignore"):
        for i in np.flatnonzero(odd_x):
            out[i : i + len(y)] += x[i] * y
        for j in np.flatnonzero(odd_y):
            out[j : j + len(x)] += np.where(odd_x, 0, x) * y[j]
    return out


def convolved(a: Array, v: Array, backwards: bool, d: np.dtype, low: int, high: int, size: int = BLOCK) -> Array:
    """Cells `low` to `high` of the full convolution of two lines, the second one turned round with `backwards`.

    Each pair of blocks meets in a row of its own, so shuffles carry the longer line once for each
    block of the shorter, and no line, block or sum is on the driver.  Pairs give two blocks of the result;
    those are added up FAN at a time.
    """
    n, m = a.size, v.size
    a, v = (x.reshaped((x.size,)).astype(d) for x in (a, v))
    down, across = -(-n // size), -(-m // size)
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    left = blocks(a, lambda i: i, size, "i").select("i", F.col("b").alias("x"), F.explode(upto(across)).alias("j"))
    right = blocks(v, (lambda i: F.lit(m - 1) - i) if backwards else (lambda i: i), size, "j").select("j", F.col("b").alias("y"), F.explode(upto(down)).alias("i"))
    held = working(d)
    tail = m - (across - 1) * size  # cells of the last block

    def multiply(batches):
        for batch in batches:
            for i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "x", "y")), strict=True):
                x, y = np.frombuffer(x, held)[: n - i * size], np.frombuffer(y, held)[: tail if j == across - 1 else size]
                got = together(x, y)
                for k, part in ((i + j, got[:size]), (i + j + 1, got[size:])):
                    if len(part):
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([j // FAN], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["k", "g", "b"])

    def total(table: pa.Table) -> np.ndarray:
        out = np.zeros(size, held)
        for x in table["b"]:
            part = np.frombuffer(x.as_py(), held)
            with np.errstate(invalid="ignore"):
                out[: len(part)] += part
        return out

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"k": table["k"][:1], "g": pa.array([table["g"][0].as_py() // FAN], pa.int64()), "b": pa.array([total(table).tobytes()], pa.binary())})

    pieces = left.join(right, ["i", "j"]).select("i", "j", "x", "y").mapInArrow(multiply, "k long, g long, b binary")
    groups = -(-across // FAN)
    while groups > 1:
        pieces, groups = pieces.groupBy("k", "g").applyInArrow(add, "k long, g long, b binary"), -(-groups // FAN)

    def finish(table: pa.Table) -> pa.Table:
        k = table["k"][0].as_py()
        lo, hi = max(low, k * size), min(high, (k + 1) * size)
        part = total(table)[lo - k * size : hi - k * size] if hi > lo else np.zeros(0, held)
        cells = part > 0 if d.kind == "b" else part.view(np.uint64) if d.name == "uint64" else part.astype(d)
        return pa.table([pa.array(np.arange(lo, lo + len(part)) - low), arrow(cells, d)], [I, V])

    schema = T.StructType([T.StructField(I, T.LongType()), T.StructField(V, dt.spark_type(d))])
    return Array.of(pieces.groupBy("k").applyInArrow(finish, schema), (high - low,), d)
