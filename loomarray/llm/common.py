"""What the operators share: the cluster's shared folder, materialised tables, text in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches sent to Python hold at most this many bytes, whatever the length of single texts.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where the session names none and is local (tests), a temporary folder is made once and set; on a
    cluster such a folder would be one machine's own, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="loomarray-")
        sc.setCheckpointDir(found)
    return found


#: Folders of running applications, which go when the driver ends.
_folders: set = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the driver ends."""
    base = f"{shared_dir(spark).rstrip('/')}/loomarray-{spark.sparkContext.applicationId}"
    if base not in _folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(base)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(place)
        system.deleteOnExit(place)
        _folders.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that `df` has not: columns of its own never clash with an operator's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str):
    """The column of this name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list:
    return [quoted(c) for c in df.columns]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it again.

    A lost executor loses nothing of it, and later readers prune columns.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, and let Spark clear their shuffles."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.__dict__.pop("_shared_path", None)
        if path:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        spark = tables[0].sparkSession
        del tables
        clear_shuffles(spark)


def clear_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver collects its garbage; have it do so now."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session already sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key)) > BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # an older release without the setting
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


#: What a Python worker may drop when it turns to other work: functions that clear caches.
RELEASE: list = []


def turn_to_other_work() -> None:
    """At the start of memory-heavy work in a worker that may have served other stages: drop their caches."""
    for clear in RELEASE:
        clear()
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(f):
    """`f`, after which what it used goes back to the system: workers wait for work with little memory."""

    def run(table):
        try:
            return f(table)
        finally:
            give_back()

    return run


def lean2(f):
    """`lean` for functions of two tables (Spark counts the parameters)."""

    def run(left, right):
        try:
            return f(left, right)
        finally:
            give_back()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text, and no other column: clashing names never come along."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def plan_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects of `df`: of a Parquet scan, of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]
