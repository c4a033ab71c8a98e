"""A stream gives what the table gives."""

import datetime as d

from pyspark.sql import functions as F

from loomarray.streaming.windows import sessions, windowed


def rows(spark):
    t = d.datetime(2024, 1, 1)
    data = [(t + d.timedelta(seconds=37 * k), f"u{k % 3}", float(k % 7)) for k in range(200)]
    return spark.createDataFrame(data, "ts timestamp, user string, value double")


def test_table(spark):
    got = windowed(rows(spark), "ts", "value", "10 minutes", by=["user"])
    assert got.agg(F.sum("count"), F.sum("sum")).first() == (200, sum(k % 7 for k in range(200)))
    assert sessions(rows(spark), "ts", "value", "2 minutes", ["user"]).count() == 3
    assert windowed(rows(spark), "ts", "value", "10 minutes", "5 minutes").agg(F.sum("count")).first()[0] == 400


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), "loom_stream"
    rows(spark).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, user string, value double").option("maxFilesPerTrigger", 1).parquet(source)
    query = windowed(stream, "ts", "value", "10 minutes", by=["user"], late="1 day").writeStream.outputMode("complete").format("memory").queryName(out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = windowed(rows(spark), "ts", "value", "10 minutes", by=["user"])
    keys = ["start", "user"]
    got = spark.table(out).orderBy(*keys).select("start", "user", "count", "sum", "min", "max").collect()
    assert got == table.orderBy(*keys).select("start", "user", "count", "sum", "min", "max").collect()
