"""Exact de-duplication by skew-safe combining.

Rows are equal when their texts are identical after white space ([\\x20\\x09-\\x0D]) is deleted. Equal rows
meet in three steps, each of which groups by the whole content and not by its digest alone:

1. the partial aggregate before the first shuffle combines the equal rows of each input partition;
2. the first shuffle deals by (digest, content, salt), so that the copies of a hot text meet in `salts` tasks;
3. the second one combines the salts' winners: `salts` rows a text at most.

The rows find their winner by a join on the digest, which Spark's skew handling may split; rows of a digest
that turns out to have several contents are joined on the content as well. DataFrame functions only.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: What counts as white space here, as a regular expression for Java and RE2.
SPACE = r"[\x20\x09-\x0D]+"

#: A winner is one number, so that Spark can keep it in its hash tables: code points * STEP + (TOP - id).
STEP, TOP = Decimal(10**20), Decimal(2**63)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salts: int = 32, digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal rows, the one with the most code points in its original text stays, then the one with the
    smallest id.

    * A null text counts as the empty text; texts of white space alone equal it.
    * A null id comes after every other id; keep_id is null when only such rows have the most code points.
    * Rows that repeat the winner's id and length can't be told from it: all of them are kept.
    * Other columns are not read, so their names can't clash; an empty table gives no rows.

    `digest` maps the content to the key that rows first meet by. A weak one costs time and not exactness.
    """
    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select("id", F.char_length("text").alias("n_chars"), F.regexp_replace("text", SPACE, "").alias("content"))
        .select("*", digest(F.col("content")).alias("digest"), sha256(F.col("content")).alias("text_sha256"))
    )
    before = F.coalesce(F.lit(TOP) - F.col("id"), F.lit(Decimal(0)))  # a null id: 0, the last
    ranked = rows.select(
        "digest",
        "content",
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        (F.col("n_chars") * F.lit(STEP) + before).cast("decimal(38,0)").alias("best"),
    )
    salted = ranked.groupBy("digest", "content", "salt").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("size"))
    whole = salted.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("size").alias("size"))

    by_digest = whole.groupBy("digest").agg(F.count(F.lit(1)).alias("n_contents"), F.max("best").alias("best"), F.max("size").alias("size"))
    by_digest = written(by_digest, "exact-dedup")
    result = _decided(rows.drop("content").join(by_digest.filter("n_contents = 1"), "digest"))
    shared = by_digest.filter("n_contents > 1").select("digest")
    if not shared.isEmpty():
        few = rows.join(shared, "digest", "left_semi")
        result = result.unionByName(_decided(few.join(whole.join(shared, "digest", "left_semi"), ["digest", "content"])))
    return result


def _decided(found: DataFrame) -> DataFrame:
    before = F.pmod(F.col("best"), F.lit(STEP))
    keep_id = F.when(before > 0, F.lit(TOP) - before).cast("long")
    longest = ((F.col("best") - before) / F.lit(STEP)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("id").eqNullSafe(keep_id) & (F.col("n_chars") == longest)).alias("kept"),
        "text_sha256",
    )
