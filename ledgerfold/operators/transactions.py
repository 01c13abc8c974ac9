"""Batches, row versions and optimistic validation as queries over a log with transaction ids (column tx)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import last_before


def batch_previous(log: DataFrame) -> DataFrame:
    """What each mutation of a batch replaces, in the state before the batch or by an earlier mutation of it: tx, seq, key,
    present, prev_val. Batches follow each other in the log, so that is what the log's mutations replace."""
    last = last_before(log, "key", "seq", F.struct("kind", "val"), "__last")
    present = F.coalesce(F.col("__last")["kind"] == "put", F.lit(False))
    return last.select("tx", "seq", "key", present.alias("present"), F.when(present, F.col("__last")["val"]).alias("prev_val"))


def row_versions(log: DataFrame) -> DataFrame:
    """The last transaction that touched each key: key, version. A put and delete back to the start is seen as well."""
    return log.groupBy("key").agg(F.max("tx").alias("version"))


def conflicts(log: DataFrame, reads: DataFrame) -> DataFrame:
    """Declared reads (tx, key, snapshot) whose key was touched after the snapshot and before the transaction: tx, key,
    version (the last such touch).

    That is the key's last touch as of the transaction, if it is later than the snapshot; reads aren't joined with
    all touches of their keys.
    """
    touched = log.select("key", F.col("tx").alias("touch")).distinct().select("key", (F.col("touch") * 2 + 1).alias("at"), "touch", F.lit(None).cast("long").alias("snapshot"))
    asked = reads.select("key", (F.col("tx") * 2).alias("at"), F.lit(None).cast("long").alias("touch"), "snapshot").distinct()
    found = last_before(touched.unionByName(asked), "key", "at", F.col("touch"), "version")
    return found.filter(F.col("version") > F.col("snapshot")).select(F.expr("at div 2").alias("tx"), "key", "version").distinct()


def oversized(log: DataFrame, most: int = 1024) -> DataFrame:
    """Transactions of more mutations than allowed: tx, n."""
    return log.groupBy("tx").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
