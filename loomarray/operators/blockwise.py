"""Products of matrices in dense blocks: cells are packed into blocks once, and only blocks meet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, div
from loomarray.operators.dense import _in, arrow

#: Rows and columns of a block at most; inner places of a block at most.
SIDE, INNER = 512, 2048
#: Products of two blocks that one task does for an inner block, about.
PAIRS = 256


def packed(a: Array, rows: int, cols: int, by_row: str, by_col: str) -> DataFrame:
    """One row a block: its block row and column under the given names, and the values' bytes (column `b`)."""
    n, m = a.shape
    d = a.dtype
    r, c = div(F.col(I), m), F.col(I) % m
    cells = a.df.select(div(r, rows).alias(by_row), div(c, cols).alias(by_col), (r % rows * cols + c % cols).alias("p"), V)

    def run(table: pa.Table) -> pa.Table:
        block = np.zeros(rows * cols, d)
        block[table["p"].to_numpy()] = _in(table[V], d)
        return pa.table({by_row: table[by_row][:1], by_col: table[by_col][:1], "b": pa.array([block.tobytes()], pa.binary())})

    return cells.groupBy(by_row, by_col).applyInArrow(run, f"{by_row} long, {by_col} long, b binary")


def product(a: Array, b: Array) -> Array:
    """The product of two matrices of one element type.

    Blocks of the two join on the inner block; each pair is one dense product in a worker; pairs of a block of
    the result are added before they leave a task, and then in a group of their own.  A task holds some
    blocks, whatever the size of the matrices; what is shuffled is each block once for each block
    across from it, not a row for each product of cells.
    """
    (n, m), (_, k) = a.shape, b.shape
    d = a.dtype
    rows, inner, cols = min(n, SIDE), min(m, INNER), min(k, SIDE)
    left = packed(a, rows, inner, "r", "j").withColumnRenamed("b", "x")
    right = packed(b, inner, cols, "j", "c").withColumnRenamed("b", "y")
    # pairs with one inner block are spread over `ways` tasks, for which the right blocks go to each
    down, across = -(-n // rows), -(-k // cols)
    ways = max(1, min(down, -(-down * across // PAIRS)))
    left = left.withColumn("s", F.col("r") % ways)
    right = right.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    plain = d if d.kind != "b" else np.dtype("int8")

    def multiply(batches):
        held: dict = {}
        for batch in batches:
            for r, c, x, y in zip(*(batch.column(name).to_pylist() for name in ("r", "c", "x", "y")), strict=True):
                one = np.frombuffer(x, d).reshape(rows, inner).astype(plain) @ np.frombuffer(y, d).reshape(inner, cols).astype(plain)
                held[r, c] = held[r, c] + one if (r, c) in held else one
                if len(held) > 16:  # a few at a time, so memory stays small
                    yield flush(held)
        if held:
            yield flush(held)

    def flush(held):
        out = pa.RecordBatch.from_arrays([pa.array([r for r, _ in held], pa.int64()), pa.array([c for _, c in held], pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["r", "c", "b"])
        held.clear()
        return out

    parts = left.join(right, ["j", "s"]).select("r", "c", "x", "y").mapInArrow(multiply, "r long, c long, b binary")

    def total(table: pa.Table) -> pa.Table:
        r, c = table["r"][0].as_py(), table["c"][0].as_py()
        whole = np.zeros((rows, cols), plain)
        for x in table["b"]:
            whole += np.frombuffer(x.as_py(), plain).reshape(rows, cols)
        whole = whole[: min(rows, n - r * rows), : min(cols, k - c * cols)].astype(d)
        at = (np.arange(whole.shape[0])[:, None] + r * rows) * k + np.arange(whole.shape[1]) + c * cols
        return pa.table([pa.array(at.ravel()), arrow(whole, d)], [I, V])

    schema = T.StructType([T.StructField(I, T.LongType()), T.StructField(V, dt.spark_type(d))])
    return Array.of(parts.groupBy("r", "c").applyInArrow(total, schema), (n, k), d)
