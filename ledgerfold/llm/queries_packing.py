"""The query of best-fit packing. SQL can't tokenize: tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
SQL: dict[str, str] = {}
