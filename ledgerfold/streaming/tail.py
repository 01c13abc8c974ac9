"""Current state of a mutation log that is still being written, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import newest

LOG = "seq long, key long, kind string, val long"


def live_state(spark: SparkSession, folder: str, state: str, checkpoint: str):
    """A query that follows Parquet files of mutations in `folder` and keeps the newest one of each key below `state`.

    Each micro-batch merges its own newest mutations with the last state and writes a new one, named by the batch. A
    batch that runs again writes the same rows to the same place, so failures leave neither gaps nor doubles. Two states
    are kept.
    Start it with .start(), or for what is there now with .trigger(availableNow=True).start().
    """

    def merge(batch: DataFrame, number: int) -> None:
        own = newest(batch, "key")
        earlier = [n for n in state_batches(batch.sparkSession, state) if n < number]
        if earlier:
            own = newest(own.unionByName(batch.sparkSession.read.schema(LOG).parquet(f"{state}/batch={max(earlier)}")), "key")
        own.select("seq", "key", "kind", "val").write.mode("overwrite").parquet(f"{state}/batch={number}")
        # The last state stays for readers that found it before this one; no batch that may run again needs older ones.
        for old in earlier[:-1]:
            _delete(batch.sparkSession, f"{state}/batch={old}")

    return spark.readStream.schema(LOG).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def state_batches(spark: SparkSession, state: str) -> list[int]:
    """Numbers of the states that were written whole."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(state)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = [s.getPath() for s in files.listStatus(path) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The live rows of the last state: key, seq, val."""
    numbers = state_batches(spark, state)
    rows = spark.read.schema(LOG).parquet(f"{state}/batch={numbers[-1]}") if numbers else spark.createDataFrame([], LOG)
    return rows.filter("kind = 'put'").select("key", "seq", "val")


def windowed_activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Mutations by kind in tumbling windows of a stream (or table) with ts and event_type, late rows bounded."""
    by = F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(by, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
