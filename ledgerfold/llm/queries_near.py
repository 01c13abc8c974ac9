"""The query of near-duplicates. SQL can't make the signatures: tests hold it against all pairs of a fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .near_dedup import near_dedup


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
SQL: dict[str, str] = {}
