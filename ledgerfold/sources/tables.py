"""The driver's tables, and the mutation log, tables and evidence that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import Schema, Table

ORDERS = Schema((("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "text"), ("o_orderpriority", "text")), "o_orderkey")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    """events as a mutation log: seq, key, kind, val, and tx (ten mutations each)."""
    return read(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("key"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("kind"),
        F.round(F.col("value") * 100).cast("long").alias("val"),
        F.expr("event_id div 10").alias("tx"),
    )


def orders_table(spark: SparkSession, folder: str) -> Table:
    return Table("orders", ORDERS, read(spark, folder, "orders"))


def order_mutations(spark: SparkSession, folder: str) -> DataFrame:
    """Upserts of all orders, then other statuses for every seventh key, then deletes of every fifth."""
    orders = orders_table(spark, folder).rows
    columns = [c for c, _ in ORDERS.columns]
    first = orders.select((F.col("o_orderkey") * 4).alias("seq"), F.lit("upsert").alias("op"), *columns)
    second = orders.filter("o_orderkey % 7 = 0").select((F.col("o_orderkey") * 4 + 1).alias("seq"), F.lit("upsert").alias("op"), *[F.lit("X").alias(c) if c == "o_orderstatus" else c for c in columns])
    third = orders.filter("o_orderkey % 5 = 0").select((F.col("o_orderkey") * 4 + 2).alias("seq"), F.lit("delete").alias("op"), *columns)
    return first.unionByName(second).unionByName(third)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "excluded").otherwise("included")
    first = F.round(F.col("value") * 100).cast("long")
    return read(spark, folder, "events").select(
        F.col("event_id").alias("pair_index"), kind.alias("disposition"), (F.lit(1).cast("long").bitwiseXOR(F.col("event_id").bitwiseAND(F.lit(1).cast("long")))).alias("pair_order"), first.alias("first"), (first + 1).alias("second")
    )


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """One for every second failed pair, two for every fortieth event, and some that belong to no pair."""
    pairs = ledger(spark, folder)
    own = pairs.filter("disposition = 'failed' AND pair_index % 2 = 0").select("pair_index", (F.col("pair_index") % 2).alias("repetition"))
    again = pairs.filter("disposition = 'failed' AND pair_index % 40 = 0").select("pair_index", F.lit(1).cast("long").alias("repetition"))
    lost = pairs.filter("pair_index % 50 = 0").select((F.col("pair_index") + 1_000_000_000).alias("pair_index"), F.lit(0).cast("long").alias("repetition"))
    return own.unionByName(again).unionByName(lost)


def timings(spark: SparkSession, folder: str) -> DataFrame:
    val = F.round(F.col("value") * 100).cast("long")
    return read(spark, folder, "events").select(
        F.col("event_type").alias("operation"), (F.col("user_id") % 2).alias("side"), (F.col("event_id") % 2).alias("order"), val.alias("duration"),
        F.when(F.col("event_id") % 3 != 0, val).alias("work"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("step"),
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """orders as the listing of a generation folder: every id's log but for every eleventh, and other kinds by status."""
    orders = read(spark, folder, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "marker").when(F.col("o_orderstatus") == "O", "staging").otherwise("reserved")
    return orders.select(F.col("o_orderkey").alias("id"), kind.alias("kind")).unionByName(orders.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), F.lit("log").alias("kind")))
