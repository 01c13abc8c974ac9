"""The query of merge-dropout. SQL can't tokenize: tests hold it against a plain agenda and the exact round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .merge_dropout import round_trip


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments every text with merge-dropout and decodes it: text_sha256 is that of the decoded text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = round_trip(table(spark, sf_dir, "documents"), model, rate=0.1, seed=20240229)
    return back.select("doc_id", "n_tokens", "ids_crc32", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
SQL: dict[str, str] = {}
