"""Cleaning a corpus for training: toxic documents go, then those of no certain language, then shared lines, then
near copies, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import language_id, toxicity
from ledgerfold.llm.common import free_name, table, written
from ledgerfold.llm.line_dedup import line_dedup
from ledgerfold.llm.near_dedup import near_dedup
from ledgerfold.llm.packing import pack

#: A document goes if it is at least as likely toxic as not, and if its language is less than this likely.
TOXIC, LANGUAGE = 0.5, 0.5

#: No SQL: the classifiers, signatures and ids can't be said in it. Tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't find toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(model, F.col("text")) < TOXIC)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier, trained on their declared languages, is sure enough of."""
    model = language_id.train(docs)
    found = language_id.language(model, F.col("text"))
    return docs.filter((found["lang"] != language_id.UNDETERMINED) & (found["score"] >= LANGUAGE))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars follows the text."""
    counts = free_name("__n_lines", docs), free_name("__n_dropped", docs)
    left, dropped = line_dedup(docs, keep_columns=True, counts=counts), F.col(counts[1]) > 0
    n_chars = F.when(dropped, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies; of a class without ids, one. Rows that repeat both id
    and text are one document and stay together."""
    kept = near_dedup(docs, with_text_hash=True).filter("kept").select(F.col("doc_id").alias("__kept"), F.col("text_hash").alias("__text_hash")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]) & (F.xxhash64(docs["text"]) == kept["__text_hash"]), "left_semi")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("line dedup", drop_shared_lines),
    ("near dedup", drop_near_copies),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
