"""NPY and NPZ.

A reader looks at the header on the driver and reads the values in blocks on the executors, each from
its place in the file; a writer streams the values in order.  Bytes in memory work the same, on the
driver.  Files are reached through Arrow's file systems, so a path may be on any store that has one.
"""

from __future__ import annotations

import contextlib
import io
import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, asarray, local, session
from loomarray.operators.dense import _in, arrow

#: Values of one block.
BLOCK = 1 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    import os

    return fs.LocalFileSystem(), os.path.abspath(path)


@contextlib.contextmanager
def replacing(path: str):
    """A stream to a file that takes the place of `path` when it is whole: what is written may come from the old one."""
    system, p = store(path)
    own = f"{p}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(own) as f:
            yield f
        system.move(own, p)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(own)
        raise


def shared_folder(spark: SparkSession) -> str:
    """A folder in the one that driver and executors share; without a setting, only a local session has one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="loomarray-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/loomarray-files"
    system, p = store(folder)
    system.create_dir(p, recursive=True)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.{name}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.create(place).close()
    system.deleteOnExit(place)
    return path


def parse_descriptor(text: str) -> np.dtype:
    """The element type of a header's descr; types without a number are refused."""
    d = np.dtype(text)
    if d.kind in "SUOVMm":
        raise TypeError(f"unsupported element type: {text}")
    dt.dtype(d.newbyteorder("="))
    return d


def parse_header(data: bytes) -> dict:
    """version, descr, fortran_order, shape and the offset of the values."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    version = (data[6], data[7])
    if version not in ((1, 0), (2, 0), (3, 0)):
        raise ValueError(f"unsupported NPY version {version}")
    wide = version[0] > 1
    size = struct.unpack("<I" if wide else "<H", data[8 : 12 if wide else 10])[0]
    start = 12 if wide else 10
    import ast

    head = ast.literal_eval(data[start : start + size].decode("utf-8" if version[0] == 3 else "latin1"))
    return {"version": version, "descr": parse_descriptor(head["descr"]), "fortran_order": head["fortran_order"], "shape": tuple(head["shape"]), "offset": start + size}


def parse_data(data: bytes, head: dict) -> Array:
    values = np.frombuffer(data, head["descr"], math.prod(head["shape"]), head["offset"])
    values = values.reshape(head["shape"], order="F" if head["fortran_order"] else "C")
    return local(np.ascontiguousarray(values.astype(head["descr"].newbyteorder("="))).reshape(head["shape"]))


def parse(data: bytes) -> Array:
    return parse_data(data, parse_header(data))


def header(shape, d: np.dtype) -> bytes:
    """Version 1 (2 if long), padded so that the values start at a multiple of 64."""
    text = f"{{'descr': '{np.lib.format.dtype_to_descr(d)}', 'fortran_order': False, 'shape': {tuple(shape)}, }}".encode("latin1")
    short = len(text) + 11 < 65536
    lead = 10 if short else 12
    text += b" " * (-(lead + len(text) + 1) % 64) + b"\n"
    return b"\x93NUMPY" + (b"\x01\x00" + struct.pack("<H", len(text)) if short else b"\x02\x00" + struct.pack("<I", len(text))) + text


def values(a: Array, block: int = BLOCK) -> Iterator[bytes]:
    """The values' bytes in order: executors put blocks together, the driver takes one after the other."""
    d, size = a.dtype, a.size

    def run(table: pa.Table) -> pa.Table:
        k = table["_b"][0].as_py()
        out = np.zeros(min(block, size - k * block), d)
        out[table["_p"].to_numpy()] = _in(table[V], d)
        return pa.table([pa.array([k]), pa.array([out.tobytes()], pa.binary())], ["k", "data"])

    df = a.df.select(F.call_function("div", F.col(I), F.lit(block)).alias("_b"), (F.col(I) % block).alias("_p"), V)
    for r in df.groupBy("_b").applyInArrow(run, "k long, data binary").orderBy("k").toLocalIterator():
        yield bytes(r.data)


def serialize(a) -> bytes:
    a = asarray(a)
    return header(a.shape, a.dtype) + b"".join(values(a))


def save(path: str, a) -> None:
    a = asarray(a)
    with replacing(path) as f:
        f.write(header(a.shape, a.dtype))
        for part in values(a):
            f.write(part)


def load(path: str, block: int = BLOCK) -> Array:
    """An NPY file; its values are read in blocks on the executors."""
    system, p = store(path)
    with system.open_input_file(p) as f:
        head = parse_header(f.read(1 << 16))
    return _values(path, 0, head, block)


def _values(path: str, start: int, head: dict, block: int = BLOCK) -> Array:
    """The array of an NPY file that begins at byte `start`."""
    shape = head["shape"]
    out = blocks_of(path, head["descr"], start + head["offset"], shape if not head["fortran_order"] else shape[::-1], block)
    from loomarray.operators.shape import transpose

    return transpose(out) if head["fortran_order"] else out


def blocks_of(path: str, d: np.dtype, start: int, shape, block: int = BLOCK) -> Array:
    """Values of type `d` (of either byte order) from byte `start` of a file, a block of them at a time."""
    n, native = math.prod(shape), d.newbyteorder("=")
    system, p = store(path)
    loaded = system.get_file_info(p)
    state = loaded.size, loaded.mtime_ns

    def run(batches):
        system, p = store(path)
        now = system.get_file_info(p)
        if (now.size, now.mtime_ns) != state:
            raise OSError(f"{path} has changed since it was loaded")
        with system.open_input_file(p) as f:
            held, x = -1, np.empty(0)
            for b in batches:
                places = b.column(0).to_numpy()  # neighbours, ascending
                while len(places):
                    if (k := int(places[0]) // block) != held:
                        f.seek(start + k * block * d.itemsize)
                        held, x = k, np.frombuffer(f.read(min(block, n - k * block) * d.itemsize), d).astype(native)
                    own = places[: int(np.searchsorted(places, (k + 1) * block))]
                    yield pa.RecordBatch.from_arrays([pa.array(own), arrow(x[own - k * block], native)], [I, V])
                    places = places[len(own) :]

    schema = T.StructType([T.StructField(I, T.LongType()), T.StructField(V, dt.spark_type(native))])
    # a range of all places, not of blocks: the optimizer knows the size by it
    return Array.of(session().range(n).mapInArrow(run, schema), shape, native)


# ---- ZIP and NPZ
def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def read_zip(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


def write_zip(files: dict[str, bytes], compress: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def parse_npz(data: bytes, force: bool = False) -> dict[str, Array]:
    """Arrays by name.  Members of types without a number raise, or are left out with `force`."""
    out = {}
    for name, member in read_zip(data).items():
        if name.endswith(".npy"):
            try:
                out[name.removesuffix(".npy")] = parse(member)
            except TypeError:
                if not force:
                    raise
    return out


def serialize_npz(arrays, compress: bool = False) -> bytes:
    named = arrays if isinstance(arrays, dict) else {f"arr_{k}": a for k, a in enumerate(arrays)}
    return write_zip({f"{k}.npy": serialize(a) for k, a in named.items()}, compress)


def load_npz(path: str, force: bool = False) -> dict[str, Array]:
    """Arrays by name, as `parse_npz` has them; values are read in blocks on the executors.

    The driver passes over each member once, a piece at a time, for its checksum; what is compressed, which can only
    be read from its beginning, goes to a file of its own in the shared folder meanwhile.
    """
    system, p = store(path)
    out = {}
    with system.open_input_file(p) as f, zipfile.ZipFile(f) as z:
        for info in z.infolist():
            if not info.filename.endswith(".npy"):
                continue
            with z.open(info) as member:
                try:
                    head = parse_header(member.read(1 << 16))
                except TypeError:
                    if not force:
                        raise
                    continue
            if info.compress_type == zipfile.ZIP_STORED:
                f.seek(info.header_offset + 26)
                own, start = path, info.header_offset + 30 + sum(struct.unpack("<HH", f.read(4)))
                target = contextlib.nullcontext()
            else:
                own, start = scratch(session(), "npy"), 0
                target = replacing(own)
            with z.open(info) as member, target as copy:
                while piece := member.read(BLOCK):
                    if copy is not None:
                        copy.write(piece)
            out[info.filename.removesuffix(".npy")] = _values(own, start, head)
    return out


def save_npz(path: str, arrays, compress: bool = False) -> None:
    """Members are written in turn, block after block; none is put together on the driver."""
    named = arrays if isinstance(arrays, dict) else {f"arr_{k}": a for k, a in enumerate(arrays)}
    with replacing(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED) as z:
        for name, a in named.items():
            a = asarray(a)
            with z.open(f"{name}.npy", "w", force_zip64=True) as member:
                member.write(header(a.shape, a.dtype))
                for part in values(a):
                    member.write(part)


def savez(path: str, *args, **named) -> None:
    save_npz(path, {**{f"arr_{k}": a for k, a in enumerate(args)}, **named})


def savez_compressed(path: str, *args, **named) -> None:
    save_npz(path, {**{f"arr_{k}": a for k, a in enumerate(args)}, **named}, True)


def load_any(path: str):
    """An array of an NPY file, or arrays by name of an NPZ file."""
    system, p = store(path)
    with system.open_input_file(p) as f:
        zipped = f.read(4)[:2] == b"PK"
    return load_npz(path) if zipped else load(path)


def to_file(a, path: str, sep: str = "", format: str = "%s") -> None:  # noqa: A002
    """Raw values, or text with a separator."""
    a = asarray(a)
    system, p = store(path)
    with system.open_output_stream(p) as f:
        if not sep:
            for part in values(a):
                f.write(part)
        else:
            first = True
            for part in values(a):
                text = sep.join(format % x for x in np.frombuffer(part, a.dtype).tolist())
                f.write(((b"" if first else sep.encode()) + text.encode()))
                first = False
