"""The query of the license scan, with the same in DuckDB's SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .license_scan import PHRASES, TEMPLATES, license_scan


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks are lines, and windows of words wherever lines end."""
    return license_scan(table(spark, sf_dir, "documents"), wrapped=True)


def op7_license_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks are lines alone: notices that are wrapped over several lines are left out."""
    return license_scan(table(spark, sf_dir, "documents"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql(wrapped: bool) -> str:
    phrases = ", ".join(f"('{label}', {_list(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', {_list(sorted(set(w.split())))}, {math.ceil(round(0.9 * len(set(w.split())), 9))}, {len(w.split())})" for label, w in TEMPLATES)
    windows = "SELECT w.doc_id, list_slice(words, i + 1, i + t.length) AS set, t.label, t.set AS wanted, t.need FROM w, t, unnest(range(len(words))) r(i) WHERE len(list_intersect(words, t.set)) >= t.need AND list_contains(t.set, words[i + 1])"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {word}) AS words FROM d),
p(label, parts) AS (VALUES {phrases}),
hits AS (SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i: list_slice(words, i + 1, i + len(parts)) = parts)) AS place FROM w, p WHERE list_has_all(words, parts)),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list_sort(list(DISTINCT label)) AS labels FROM hits GROUP BY doc_id),
t(label, set, need, length) AS (VALUES {templates}),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {word})) AS set FROM d),
cand AS (SELECT b.doc_id, b.set, t.label, t.set AS wanted, t.need FROM blocks b, t WHERE len(b.set) >= t.need{" UNION ALL " + windows if wrapped else ""}),
m AS (SELECT doc_id, label, len(list_intersect(set, wanted)) / len(wanted) AS part FROM cand WHERE len(list_intersect(set, wanted)) >= need),
method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(part) AS most FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN method ON w.doc_id = method.doc_id
"""


QUERIES = {"op7_license_scan": op7_license_scan, "op7_license_scan_lines": op7_license_scan_lines}
SQL = {"op7_license_scan": _sql(wrapped=True), "op7_license_scan_lines": _sql(wrapped=False)}
