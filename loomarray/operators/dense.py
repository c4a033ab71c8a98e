"""Dense kernels that no Column expression has: lines or matrices go to NumPy in Arrow batches, one group at a time.

A line (or matrix) has to fit in a task; stacks of them spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, coords, ravel


def _in(column, d: np.dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    if d.kind == "c":
        re, im = column.flatten()
        return (re.to_numpy(zero_copy_only=False) + 1j * im.to_numpy(zero_copy_only=False)).astype(d)
    if d.name == "uint64":
        return np.array([int(x) for x in column.to_pylist()], np.uint64)
    return column.to_numpy(zero_copy_only=False).astype(d)


def arrow(values: np.ndarray, d: np.dtype):
    values = np.asarray(values, d).ravel()
    if d.kind == "c":
        p = dt.part(d)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values.real, p)), pa.array(np.ascontiguousarray(values.imag, p))], ["re", "im"])
    if d.name == "uint64":
        from decimal import Decimal

        return pa.array([Decimal(int(x)) for x in values], pa.decimal128(20, 0))
    held = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64, "float16": np.float32}.get(d.name, d)
    return pa.array(values.astype(held))


#: Blocks up to so many cells travel packed, thousands in a batch; larger ones are a batch of their own.
PACKED = 1 << 10


class Kept:
    """A frame that several arrays read, persisted as long as one of them is there.  Later plans of it run it again."""

    def __init__(self, df):
        self.df = df.persist()

    def __del__(self):
        from py4j.protocol import Py4JError

        try:
            self.df.unpersist()
        except (Py4JError, OSError, TypeError, AttributeError):  # the session has ended
            return


def blocks(a: Array, axes: Sequence[int], f: Callable[[np.ndarray], np.ndarray | tuple], outs: Sequence[tuple[Sequence[int], np.dtype]]) -> list[Array]:
    """`f` on every block over `axes` (put last, in that order); each result has a shape and type in `outs`.

    Small blocks are packed into rows, of which a batch has thousands; those of an array whose rows are vectors of a
    table (`from_vectors`) are packed already, and nothing is shuffled.
    """
    rest = [k for k in range(a.ndim) if k not in axes]
    inner, outer = [a.shape[k] for k in axes], [a.shape[k] for k in rest]
    d, m = a.dtype, int(np.prod(inner))
    cs = coords(F.col(I), a.shape)
    cells = lambda: a.df.select(ravel([cs[k] for k in rest], outer).alias("_o"), ravel([cs[k] for k in axes], inner).alias("_p"), V)
    fields = [T.StructField("_n", T.IntegerType()), T.StructField(I, T.LongType())]
    fields += [T.StructField(f"v{k}", dt.spark_type(t)) for k, (_, t) in enumerate(outs)]
    sizes = [int(np.prod(s)) for s, _ in outs]
    kinds = [t for _, t in outs]
    held = [arrow(np.empty(0, t), t).type for t in kinds]

    def results(o: np.ndarray, stack: np.ndarray):
        """A batch for each result of all blocks of `stack`, of which number o[r] is the place of the r-th."""
        got = [x if isinstance(x, tuple) else (x,) for x in map(f, stack.reshape(-1, *inner))]
        for k, (n, t) in enumerate(zip(sizes, kinds, strict=True)):
            values = np.concatenate([np.asarray(x[k], t).ravel() for x in got])
            columns = [pa.nulls(len(values), h) for h in held]
            columns[k] = arrow(values, t)
            index = (o[:, None] * n + np.arange(n)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(index), *columns], [c.name for c in fields])

    def one(table: pa.Table) -> pa.Table:
        block = np.zeros(m, d)
        block[table["_p"].to_numpy()] = _in(table[V], d)
        return pa.Table.from_batches(results(np.array([table["_o"][0].as_py()]), block))

    def many(batches):
        for batch in batches:
            lists = batch.column(1)
            stack = np.zeros((batch.num_rows, m), d)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            place, values = lists.flatten().flatten()
            stack[row, place.to_numpy()] = _in(values, d)
            if batch.num_rows:
                yield from results(batch.column(0).to_numpy(), stack)

    def rows(batches):
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy()
            stack = np.zeros((batch.num_rows, width), d)
            stack[np.arange(width) < size[:, None]] = _in(lists.flatten(), d)
            if batch.num_rows:
                per = width // m
                yield from results((batch.column(0).to_numpy()[:, None] * per + np.arange(per)).ravel(), stack.reshape(-1, m))

    schema = T.StructType(fields)
    vectors = a._vectors
    if vectors is not None and m <= PACKED and list(axes) == list(range(a.ndim - len(axes), a.ndim)) and vectors[3] % m == 0:
        table, key, vector, width = vectors
        out = table.select(key.alias("_o"), vector.alias("x")).mapInArrow(rows, schema)
    elif m <= PACKED:
        out = cells().groupBy("_o").agg(F.collect_list(F.struct("_p", V)).alias("x")).mapInArrow(many, schema)
    else:
        out = cells().groupBy("_o").applyInArrow(one, schema)
    kept = Kept(out) if len(outs) > 1 else None
    arrays = [Array.of(out.where(F.col("_n") == k).select(I, F.col(f"v{k}").alias(V)), (*outer, *s), t) for k, (s, t) in enumerate(outs)]
    for a in arrays:
        a._kept = kept
    return arrays


def along(a: Array, axis: int, f: Callable[[np.ndarray], np.ndarray], length: int, dtype) -> Array:
    """`f` on every line along `axis` (a vector), which becomes a line of `length`."""
    (out,) = blocks(a, [axis], f, [((length,), np.dtype(dtype))])
    from loomarray.operators.shape import moveaxis

    return moveaxis(out, -1, axis)
