"""Removal of lines that many documents share.

Lines are exploded with their positions, normalised and hashed; the distinct documents of every hash are
counted; lines over the threshold go from all documents but the one with the largest id, and what is left is
put together again by position. Only hashes and positions are shuffled, never a line's text, and no step
collects the rows of a line: the counts are pre-aggregated and the join may be split. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The white space that a key loses at both ends.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters outside ASCII that lower() would change; lines without them can take the faster lower().
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def line_key(line: Column) -> Column:
    """The line without white space ([\\x20\\x09-\\x0D]) at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(bare.rlike(OTHER_UPPER), F.translate(bare, UPPER, LOWER)).otherwise(F.lower(bare))


def _lines(docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.md5(text).alias("__text"), F.split(text, "\n", -1).alias("__lines"), *others)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5, keep_columns: bool = False, counts: tuple[str, str] = ("__n_lines", "__n_dropped")) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (before), n_dropped, text (after). With keep_columns: the columns
    of docs with the new text in text_col, then the two counts under the names of `counts`; columns of docs that have
    these names (in any case) are replaced.

    Lines end at \\n. Those whose key has at least min_chars code points and is found in at least min_docs
    distinct documents are dropped, except in the largest id that holds the key, where all of them stay.

    * A null or empty text is one empty line and becomes the empty text.
    * A null id is no document for the count and never the largest; its lines go like any other's.
    * Rows that repeat an id are one document for the count; each loses its own lines.
    * Other columns aren't looked at; an empty table gives no rows.
    """
    others = [F.col(c).alias(f"__own_{i}") for i, c in enumerate(docs.columns)] if keep_columns else []
    split = _lines(docs, id_col, text_col, [])
    keyed = (
        split.select("__id", "__text", F.posexplode("__lines").alias("__pos", "__line"))
        .select("__id", "__text", "__pos", line_key(F.col("__line")).alias("__key"))
        .filter(F.char_length("__key") >= min_chars)
        .select("__id", "__text", "__pos", F.unhex(F.md5("__key")).alias("__hash"))
    )
    common = (
        keyed.groupBy("__hash")
        .agg(F.count_distinct("__id").alias("__docs"), F.max("__id").alias("__keeper"))
        .filter(F.col("__docs") >= min_docs)
        .select("__hash", "__keeper")
    )
    common = written(common, "common-lines")  # so that the join below has a shuffle on both sides, which Spark may split
    dropped = (
        keyed.join(common, "__hash")
        .filter(~F.col("__id").eqNullSafe(F.col("__keeper")))
        .groupBy("__id", "__text")
        .agg(F.collect_set("__pos").alias("__gone"))
        .select(F.coalesce("__id", F.lit(0)).alias("__id"), F.col("__id").isNull().alias("__no_id"), "__text", "__gone")
    )
    whole = _lines(docs, id_col, text_col, others).select("*", F.col("__id").isNull().alias("__no_id"), F.col("__id").alias("__doc_id")).withColumn("__id", F.coalesce("__id", F.lit(0)))
    joined = whole.join(dropped, ["__id", "__no_id", "__text"], "left")
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    left = F.transform(F.array_except(places, F.col("__gone")), lambda i: F.get("__lines", i))
    text = F.array_join(F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(left), "\n")
    n_lines, n_dropped = F.size("__lines").cast("long"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    if keep_columns:
        replaced = {c.lower() for c in counts}
        own = [text.alias(c) if c == text_col else F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in replaced]
        return joined.select(*own, n_lines.alias(counts[0]), n_dropped.alias(counts[1]))
    return joined.select(F.col("__doc_id").alias("doc_id"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), text.alias("text"))
