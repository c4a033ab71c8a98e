"""Factorisations of one tall matrix: blocks of rows are factored each in a task, their triangles in a tree.

The triangles of FAN neighbouring blocks stand on each other and are factored again, until one is left.  What the
root makes of it (signs, singular vectors, an inverse) goes down the same tree, where each node multiplies it by its
own orthogonal piece, and at last each block of rows does.  No task holds more than a block or FAN triangles, and
nothing of the matrix comes to the driver.  Only how orthogonal the pieces are counts, not how well conditioned the
matrix is, so results are as good as Householder's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, div
from loomarray.operators.dense import _in, arrow

#: Cells from which a matrix goes this way, if it has at least twice as many rows as columns; cells of a block, about.
TALL, BLOCK = 1 << 22, 1 << 20
#: Columns at most, so that triangles fit in a task.
COLUMNS = 1024


def fits(a: Array) -> bool:
    return a.ndim == 2 and a.dtype.kind == "f" and a.size >= TALL and 0 < a.shape[1] <= COLUMNS and a.shape[0] >= 2 * a.shape[1]


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def _matrix(x: bytes, width: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(-1, width)


class Tree:
    """The blocks' factors and the levels above them; without `q` only triangles are kept."""

    def __init__(self, a: Array, q: bool):
        m, n = a.shape
        d = a.dtype
        self.shape, self.dtype, self.rows = a.shape, d, max(2 * n, BLOCK // n)
        rows, fan = self.rows, max(2, min(32, 4 * BLOCK // (n * n)))
        place = F.col(I) % (rows * n)
        cells = a.df.select(div(F.col(I), rows * n).alias("k"), place.alias("p"), V)

        def factor(table: pa.Table) -> pa.Table:
            k = table["k"][0].as_py()
            block = np.zeros(min(rows, m - k * rows) * n)
            block[table["p"].to_numpy()] = _in(table[V], d)
            got = np.linalg.qr(block.reshape(-1, n), "reduced" if q else "r")
            piece, r = (_bytes(got[0]), got[1]) if q else (None, got)
            return pa.table({"k": [k], "q": pa.array([piece], pa.binary()), "r": pa.array([_bytes(r)], pa.binary())})

        def join(table: pa.Table) -> pa.Table:
            table = table.sort_by("k")
            parts = [_matrix(x.as_py(), n) for x in table["r"]]
            whole = np.concatenate(parts)
            got = np.linalg.qr(whole, "reduced" if q else "r")
            up, r = got if q else (None, got)
            pieces = [_bytes(x) for x in np.split(up, np.cumsum([len(x) for x in parts])[:-1])] if q else [None] * len(parts)
            tops = [_bytes(r)] + [None] * (len(parts) - 1)
            return pa.table({"k": table["k"], "p": table["p"], "q": pa.array(pieces, pa.binary()), "r": pa.array(tops, pa.binary())})

        kept = lambda df: df.persist() if q else df  # noqa: E731 - pieces are read again on the way down
        self.base = kept(cells.groupBy("k").applyInArrow(factor, "k long, q binary, r binary"))
        self.levels: list[DataFrame] = []
        top, count = self.base.select("k", "r"), -(-m // rows)
        while count > 1:
            level = top.withColumn("p", div(F.col("k"), fan)).groupBy("p").applyInArrow(join, "k long, p long, q binary, r binary")
            self.levels.append(kept(level))
            top, count = self.levels[-1].where(F.col("r").isNotNull()).select(F.col("p").alias("k"), "r"), -(-count // fan)
        self.top = top

    def root(self, f: Callable[..., Sequence[np.ndarray]], signs: bool = False) -> DataFrame:
        """Results of `f(triangle)`, or `f(triangle, first rows of Q)` with `signs`: rows with their number `o` and their bytes `t`."""
        n = self.shape[1]
        parts = self.top.select(F.lit(-1).alias("o"), F.col("r").alias("b"))
        if signs:  # the pieces of the first block and of what is above it: a path of the tree
            for j, df in enumerate((self.base, *self.levels)):
                parts = parts.union(df.where(F.col("k") == 0).select(F.lit(j).alias("o"), F.col("q").alias("b")))

        def finish(table: pa.Table) -> pa.Table:
            first, *path = (x.as_py() for x in table.sort_by("o")["b"])
            r = _matrix(first, n)
            given = [r]
            if path:
                head = _matrix(path[0], n)[:n]
                for x in path[1:]:
                    head = head @ _matrix(x, n)
                given.append(head)
            out = f(*given)
            return pa.table({"o": pa.array(range(len(out)), pa.int32()), "t": pa.array([_bytes(x) for x in out], pa.binary())})

        return parts.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(finish, "o int, t binary").persist()

    def small(self, root: DataFrame, o: int, shape: Sequence[int], dtype=None) -> Array:
        return _cells(root.where(F.col("o") == o).select(F.lit(0).cast("long").alias("k"), F.col("t").alias("b")), 0, shape, np.dtype(dtype or self.dtype))

    def times(self, root: DataFrame, width: int) -> Array:
        """Q times the first of the root's results, of `width` columns."""

        def multiply(batches):
            for batch in batches:
                for k, q, t in zip(*(batch.column(c).to_pylist() for c in ("k", "q", "t")), strict=True):
                    right = _matrix(t, width)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_bytes(_matrix(q, len(right)) @ right)], pa.binary())], ["k", "t"])

        down = root.where(F.col("o") == 0).select(F.lit(0).cast("long").alias("p"), "t")
        for level in reversed(self.levels):
            down = level.select("k", "p", "q").join(down, "p").select("k", "q", "t").mapInArrow(multiply, "k long, t binary").withColumnRenamed("k", "p")
        done = self.base.select("k", "q").join(down.withColumnRenamed("p", "k"), "k").select("k", "q", "t").mapInArrow(multiply, "k long, t binary")
        return _cells(done.withColumnRenamed("t", "b"), self.rows * width, (self.shape[0], width), self.dtype)


def _cells(df: DataFrame, step: int, shape: Sequence[int], d: np.dtype) -> Array:
    """Cells of blocks `b`, of which number k starts at the flat index k * step."""

    def run(batches):
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(b, np.float64)
                for at in range(0, len(x), 1 << 18):
                    part = x[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(k * step + at + np.arange(len(part))), arrow(part, d)], [I, V])

    schema = T.StructType([T.StructField(I, T.LongType()), T.StructField(V, dt.spark_type(d))])
    return Array.of(df.select("k", "b").mapInArrow(run, schema), shape, d)


def reflected(head: np.ndarray) -> np.ndarray:
    """The signs that reflections give the rows of the triangle, as LAPACK has them.

    Reflections applied to Q itself leave a diagonal of signs, each against that of the element it clears from;
    eliminating Q less those signs shows one after the other (Ballard, Demmel, Grigori, Jacquelin, Knight and Nguyen, 2015).
    """
    x, n = head.copy(), len(head)
    out = np.empty(n)
    for j in range(n):
        out[j] = -1.0 if x[j, j] >= 0 else 1.0
        x[j, j] -= out[j]
        x[j + 1 :, j] /= x[j, j]
        x[j + 1 :, j + 1 :] -= np.outer(x[j + 1 :, j], x[j, j + 1 :])
    return out


def qr(a: Array, mode: str = "reduced"):
    """Q and R with NumPy's signs; of a matrix whose columns depend on each other, any that fit."""
    n = a.shape[1]
    tree = Tree(a, True)

    def f(r, head):
        s = reflected(head)
        return np.diag(s), s[:, None] * r

    root = tree.root(f, signs=True)
    r = tree.small(root, 1, (n, n))
    return r if mode == "r" else (tree.times(root, n), r)


def svd(a: Array):
    """U, the singular values and V transposed; vectors are unique up to signs."""
    n = a.shape[1]
    tree = Tree(a, True)
    root = tree.root(lambda r: np.linalg.svd(r, full_matrices=False))
    return tree.times(root, n), tree.small(root, 1, (n,)), tree.small(root, 2, (n, n))


def of_triangle(a: Array, f: Callable[[np.ndarray], np.ndarray], shape: Sequence[int], dtype=None) -> Array:
    """What depends on the triangle alone: singular values, a condition number, a rank."""
    tree = Tree(a, False)
    return tree.small(tree.root(lambda r: (f(r),)), 0, shape, dtype)


def pinv_transposed(a: Array, rcond: float) -> Array:
    tree = Tree(a, True)
    return tree.times(tree.root(lambda r: (np.linalg.pinv(r, rcond).T,)), a.shape[1])


def lstsq(both: Array, k: int, rcond: float):
    """Of [A b], whose first `k` columns are A: solution, residuals, rank, singular values."""
    p = both.shape[1] - k
    tree = Tree(both, False)

    def f(r):
        s, _, rank, sv = np.linalg.lstsq(r[:k, :k], r[:k, k:], rcond)
        return s, np.sum(r[k:, k:] ** 2, axis=0), np.array([float(rank)]), sv

    root = tree.root(f)
    return tree.small(root, 0, (k, p)), tree.small(root, 1, (p,)), tree.small(root, 2, (), np.int64), tree.small(root, 3, (k,))
