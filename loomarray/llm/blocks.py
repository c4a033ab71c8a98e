"""Rows packed into compressed blocks, which travel and are stored as single values."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomarray.llm.common import bounded_batches, fresh_path, give_back, partitions, turn_to_other_work

#: A block holds rows of about so many bytes of text (or one row that has more).
BLOCK = 2 << 20
#: Blocks that travel together.
GROUP = 2
#: A block never has more rows than a two-byte number can tell apart.
ROWS = 60_000


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with ipc.new_stream(sink, batch.schema, options=ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_batch(data: bytes) -> pa.Table:
    with ipc.open_stream(data) as f:
        return f.read_all().combine_chunks()


def blocks(df: DataFrame, size_of: str, size: int = BLOCK) -> DataFrame:
    """The rows of `df` as blocks: group, block (unique together), n_bytes (of column `size_of`), data.

    A group has up to GROUP blocks.  They are written to the shared folder as a table bucketed by
    group, so what is known of blocks can join them without moving them.
    """
    spark = df.sparkSession
    bounded_batches(spark)

    def build(batches):
        turn_to_other_work()
        held, n, rows, count = [], 0, 0, 0
        base = TaskContext.get().partitionId() << 24

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [pa.array([base + count // GROUP]), pa.array([count % GROUP], pa.int32()), pa.array([n], pa.int64()), pa.array([pack_batch(table.to_batches()[0])], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["group", "block", "n_bytes", "data"])

        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(size_of)).fill_null(0).to_pylist()
            start = 0
            for i, x in enumerate(sizes):
                n, rows = n + x, rows + 1
                if n >= size or rows >= ROWS:
                    held.append(batch.slice(start, i + 1 - start))
                    yield out()
                    held, n, rows, start, count = [], 0, 0, i + 1, count + 1
            if start < len(sizes):
                held.append(batch.slice(start))
        if held:
            yield out()
        give_back()

    table = f"blocks_{uuid.uuid4().hex}"
    packed = df.mapInArrow(build, "group long, block int, n_bytes long, data binary")
    packed.write.option("path", fresh_path(spark, "blocks")).bucketBy(partitions(spark), "group").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the frame keeps its files and buckets; the catalog keeps nothing
    return out
