"""A log cut into sorted runs, and what reading them costs as exact integer ratios.

Runs have run_id, key, seq, kind and val; a higher run_id is newer. Counts are of runs consulted and versions
decoded; they are not device reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import SLICE, newest, ranked, value_bytes


def cut(log: DataFrame, width: int) -> DataFrame:
    """One run for every `width` sequence numbers, with each key's newest mutation in it, tombstones included."""
    return newest(log.withColumn("run_id", F.expr(f"seq div {width}")), "run_id", "key")


def visible(runs: DataFrame) -> DataFrame:
    """The newest version of each key over all runs, without tombstones: key, seq, val."""
    return newest(runs, "key").filter("kind = 'put'").select("key", "seq", "val")


def point_consults(runs: DataFrame, keys: DataFrame, slice_ids: int = SLICE) -> DataFrame:
    """How many runs a read of each key consults, newest first, until one holds it: key, consults. A key that no run
    holds has all of them consulted.

    Runs are numbered within slices of slice_ids ids, and the slices' counts are added up, so no task numbers all.
    """
    ids = runs.select("run_id").distinct()
    holds = keys.join(runs.groupBy("key").agg(F.max("run_id").alias("newest")), "key", "left")
    newer = ranked(ids, "run_id", slice_ids, descending=True).select(F.col("run_id").alias("newest"), (F.col("__rank") + 1).alias("n"))
    total = ids.agg(F.count(F.lit(1))).scalar()
    return holds.join(newer, "newest", "left").select("key", F.coalesce("n", total).alias("consults"))


def range_decoded(runs: DataFrame, start, end) -> DataFrame:
    """decoded: versions of start <= key < end in all runs; returned: live keys among them."""
    inside = runs.filter((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end)))
    per_key = inside.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("kind", "seq").alias("kind"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("decoded"), F.count_if(F.col("kind") == "put").alias("returned"))


def compaction(runs: DataFrame) -> DataFrame:
    """What merging all runs leaves: kept, tombstones_dropped, gc_watermark (the last sequence number)."""
    return newest(runs, "key").agg(F.count_if(F.col("kind") == "put").alias("kept"), F.count_if(F.col("kind") == "delete").alias("tombstones_dropped"), F.max("seq").alias("gc_watermark"))


def stats(runs: DataFrame, fresh: int) -> DataFrame:
    """Runs and entries by level: 0 for run ids from `fresh` on, 1 below."""
    level = F.when(F.col("run_id") >= fresh, F.lit(0)).otherwise(F.lit(1)).cast("long")
    return runs.groupBy(level.alias("level")).agg(F.count_distinct("run_id").alias("runs"), F.count(F.lit(1)).alias("entries"))


def write_ratio(log: DataFrame, runs: DataFrame) -> DataFrame:
    """numerator: bytes of keys and values put into the log and the runs; denominator: those of the log."""
    size = 8 + F.when(F.col("kind") == "put", value_bytes(F.col("val"))).otherwise(F.lit(0))
    stored = runs.agg(F.sum(size)).scalar()
    return log.agg(F.sum(size).alias("denominator")).select((F.col("denominator") + stored).alias("numerator"), "denominator", F.lit("byte").alias("unit"))


def space_ratio(runs: DataFrame) -> DataFrame:
    """numerator: bytes held by all runs; denominator: bytes of live keys and values."""
    size = 8 + F.when(F.col("kind") == "put", value_bytes(F.col("val"))).otherwise(F.lit(0))
    sized = runs.select("key", "seq", "kind", size.cast("long").alias("size"))
    per_key = sized.groupBy("key").agg(F.sum("size").alias("size"), F.max_by(F.struct("kind", "size"), "seq").alias("last"))
    live = F.sum(F.when(F.col("last.kind") == "put", F.col("last.size")).otherwise(F.lit(0)))
    return per_key.agg(F.sum("size").alias("numerator"), live.alias("denominator"), F.lit("byte").alias("unit"))
