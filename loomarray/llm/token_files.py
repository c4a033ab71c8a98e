"""Operator 7: token ids in Arrow files of fixed-size lists."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomarray.llm.common import fresh_path, id_text, partitions, texts_of
from loomarray.llm.tokens import Ids, tokenizer

#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH = 2048, 256


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Equal-length sequences `ids` and their `mask` as fixed-size lists, batch after batch."""

    def __init__(self, sink, width: str, length: int = LENGTH, batch: int = BATCH):
        self.width, self.length, self.batch = np.dtype(width), length, batch
        kind = pa.from_numpy_dtype(self.width)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length)})
        self.out, self.held, self.size, self.total = ipc.new_file(sink, self.schema), [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids) // self.width.itemsize
        self.total += len(ids) // self.width.itemsize
        if self.size >= self.length * self.batch:
            self.flush(False)

    def flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.held), self.width)
        step = self.length * self.batch
        stop = len(data) if last else len(data) // step * step
        for at in range(0, stop, step):
            ids = data[at : min(at + step, stop)]
            short = -len(ids) % self.length
            mask = np.ones(len(ids) + short, bool)
            mask[len(ids) :] = False
            ids = np.pad(ids, (0, short)) if short else ids
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.held = [data[stop:].tobytes()]
        self.size = len(data) - stop

    def close(self) -> int:
        self.flush(True)
        self.out.close()
        return self.total


class TokenFile:
    """A written file: sequence `i`, its mask, or any run of ids.  On a local disk nothing is copied to read one."""

    def __init__(self, uri: str):
        system, path = store(uri)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.file = ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.kept = -1, None
        #: every batch but the last holds as many sequences as the first
        self.per = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.kept = k, self.file.get_batch(k)
        return self.kept

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.per + self.batch(n - 1).num_rows if n else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence `i`."""
        b, r = self.batch(i // self.per), i % self.per
        return tuple(b.column(c).values.slice(r * self.length, self.length).to_numpy(zero_copy_only=c == 0) for c in (0, 1))

    def ids(self, start: int, n: int) -> np.ndarray:
        """`n` ids from place `start`, across sequences and batches; the mask tells padding apart."""
        step, parts = self.per * self.length, []
        while n > 0:
            b = self.batch(start // step)
            have = b.column(0).values.to_numpy()[start % step : start % step + n]
            if start % step + len(have) == len(b) * self.length:  # only the end of a batch can be padded
                have = have[b.column(1).values.to_numpy(zero_copy_only=False)[start % step : start % step + len(have)]]
            if not len(have):
                raise ValueError("the file ends before the run does")
            parts.append(have)
            start, n = start + len(have), n - len(have)
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, self.file.schema.field("ids").type.value_type.to_pandas_dtype()), *parts])

    def close(self) -> None:
        self.kept = None
        self.source.close()


@dataclass
class TokenFiles:
    """Files in the order of the documents in them, and the ids in all files before each."""

    uris: list[str]
    starts: list[int]
    total: int


def save(spark_uri: str, part: int, attempt: int, name: str, write) -> str:
    """Write under a name of this attempt, then move: a repeated or lost task leaves whole files only."""
    system, base = store(spark_uri)
    system.create_dir(base, recursive=True)
    own, final = f"{base}/_{part}-{attempt}-{name}", f"{base}/part-{part:06d}.{name}"
    with system.open_output_stream(own) as sink:
        write(sink)
    system.move(own, final)
    return f"{spark_uri}/part-{part:06d}.{name}"


def write_token_files(docs: DataFrame, path: str, end_id: int, uri: str | None = None, length: int = LENGTH) -> TokenFiles:
    """Encode every whole text, append `end_id`, and write the ids in ascending doc_id order.

    A range partition of doc_id becomes one file of sequences (`.arrow`) and one of documents
    (`.docs.arrow`: doc_id, start in the file, n_tokens).  Ids take two bytes where the vocabulary
    allows it, else four.  Only the number of ids in each file comes to the driver.

    A null text counts as empty (one id, the end); a null doc_id comes first; repeated ids stand
    next to each other, by text; an empty table gives no files with sequences.
    """
    spark = docs.sparkSession
    uri = uri or fresh_path(spark, "tokens")
    width = "<u2" if max(tokenizer(path).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"

    def write(batches):
        encode, end = Ids(path, width), np.array([end_id], width).tobytes()
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        ids, counts = [], []

        def sequences(sink):
            out = Writer(sink, width, length)
            for batch in batches:
                texts = texts_of(batch)
                ids.append(batch.column("doc_id"))
                for k in range(0, len(texts), 512):
                    for data in encode(texts[k : k + 512]):
                        out.add(data + end)
                        counts.append(len(data) // out.width.itemsize + 1)
            out.close()

        def rows(sink):
            n = np.array(counts, np.int64)
            table = pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "start": np.cumsum(n) - n, "n_tokens": n})
            with ipc.new_file(sink, table.schema) as out:
                out.write_table(table)

        name = save(uri, part, attempt, "arrow", sequences)
        save(uri, part, attempt, "docs.arrow", rows)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([sum(counts)], pa.int64())], ["part", "uri", "n"])

    ordered = id_text(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files = sorted(ordered.mapInArrow(write, "part long, uri string, n long").collect())
    starts = np.cumsum([0, *(f.n for f in files)]).tolist()
    return TokenFiles([f.uri for f in files], starts[:-1], starts[-1])


def read_token_files(spark, files: TokenFiles) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32
    (unsigned, of the ids as little-endian unsigned 32-bit integers)."""
    uris, starts = files.uris, files.starts

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                system, path = store(uris[k].removesuffix(".arrow") + ".docs.arrow")
                with system.open_input_file(path) as f:
                    rows = ipc.open_file(f).read_all()
                tokens = TokenFile(uris[k])
                crc = [zlib.crc32(tokens.ids(s, n).astype("<u4")) for s, n in zip(rows["start"].to_pylist(), rows["n_tokens"].to_pylist(), strict=True)]
                start = pa.array(rows["start"].to_numpy() + starts[k], pa.int64())
                tokens.close()
                yield from pa.table({"doc_id": rows["doc_id"], "start": start, "n_tokens": rows["n_tokens"], "ids_crc32": pa.array(crc, pa.int64())}).to_batches()

    return spark.range(0, len(uris), 1, max(1, len(uris))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    return read_token_files(docs.sparkSession, write_token_files(docs, path, end_id))
