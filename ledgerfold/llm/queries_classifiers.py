"""The queries of the trained classifiers. SQL can't train them: tests hold them against held-out labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, toxicity
from .common import table


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(remainder("doc_id", 3) != 1))
    scored = language_id.language_id(docs.select("doc_id", "text"), model, lang_col="lang_pred", score_col="score")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(remainder("doc_id", 5) != 0))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model, score_col="score")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_quality_rules": op1_quality_rules, "op4_language_id": op4_language_id, "op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
