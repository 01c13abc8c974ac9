"""What engines promise, as rows that can be compared, and checks on keys and values before any is written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput

FIELDS = ("name", "model", "architecture", "concurrency", "persistence", "recovery", "distribution", "ordered_range", "most_key_bytes", "most_value_bytes")
#: Two engines may differ in these and still be compared.
MAY_DIFFER = ("name", "architecture", "recovery")

LEDGERFOLD = {
    "name": "ledgerfold", "model": "key-value", "architecture": "log of Parquet files", "concurrency": "snapshot readers", "persistence": "durable", "recovery": "committed files",
    "distribution": "cluster", "ordered_range": "true", "most_key_bytes": "4096", "most_value_bytes": "1048576",
}


def capabilities(spark: SparkSession, engine: Mapping[str, str]) -> DataFrame:
    """One row for each field: field, value."""
    if set(engine) != set(FIELDS):
        raise InvalidInput("an engine states each capability once")
    return spark.createDataFrame([(k, str(engine[k])) for k in FIELDS], "field string, value string")


def mismatches(left: DataFrame, right: DataFrame, needs_range: bool = False) -> DataFrame:
    """Fields that keep two engines from being compared: field, left, right."""
    both = left.select("field", F.col("value").alias("left")).join(right.select("field", F.col("value").alias("right")), "field", "full")
    unlike = ~F.col("left").eqNullSafe(F.col("right")) & ~F.col("field").isin(*MAY_DIFFER)
    if needs_range:
        unlike |= (F.col("field") == "ordered_range") & ((F.col("left") != "true") | (F.col("right") != "true"))
    return both.filter(unlike)


def too_long(rows: DataFrame, most_key: int = 4096, most_value: int = 1 << 20) -> DataFrame:
    """Rows of (key, value) as bytes whose key or value is longer than allowed: key, key_bytes, value_bytes."""
    sizes = rows.select("key", F.octet_length("key").cast("long").alias("key_bytes"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("value_bytes"))
    return sizes.filter((F.col("key_bytes") > most_key) | (F.col("value_bytes") > most_value))


def require_range(engine: Mapping[str, str]) -> None:
    """Raises, with the engine's name, unless it reads ordered ranges: before any plan is made."""
    if engine["ordered_range"] != "true":
        raise InvalidInput(_no_range(engine))


def _no_range(engine: Mapping[str, str]) -> str:
    return f"engine {engine['name']} does not expose ordered range scans"


def range_rejections(steps: DataFrame, engine: Mapping[str, str]) -> DataFrame:
    """Steps (step, op, start, end) that ask an engine for a range that it rejects: step, reason. All of them if it doesn't
    read ordered ranges, else those that end before they start. A null end is no bound."""
    ranges = steps.filter("op = 'range_scan'")
    if engine["ordered_range"] != "true":
        return ranges.select("step", F.lit(_no_range(engine)).alias("reason"))
    return ranges.filter("`end` < start").select("step", F.lit("range end is before its start").alias("reason"))


def blank(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose text is null, empty or white space alone."""
    return rows.filter(F.coalesce(F.length(F.btrim(column, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)) == 0)
