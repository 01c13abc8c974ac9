"""License notices, found by phrases and by an exact set-similarity join with templates.

Blocks of a text are its lines and, with `wrapped`, all windows of as many words in a row as the template has, wherever
lines end. A template covers a block when at least `threshold` of the template's distinct words stand in it. The join
is exact and doesn't compare every pair: the words of both sides are put in one global order, rarest first (ties by the
word), and a pair becomes a candidate only if

* a word of the template's prefix (its size - need + 1 rarest) is among the block's prefix,
* the block has at least `need` template words (length filter),
* enough words follow that place on both sides to reach `need` (positional filter),

where need = ceil(threshold * size). Candidates are verified on their whole sets. A template that covers a window covers
the whole text, so the same join of templates with whole texts tells the texts whose windows are looked at.

Texts are cut into words once. What is written of each is small: how many words it has, and where those stand that
phrases or templates know; no other word can match. Their frequencies are counted over the whole corpus.
DataFrame functions only; what reaches the driver is one count for each word of the templates.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: What stands between words: ASCII but digits and a-z (after A-Z are lowered), and ends of lines. Every character is
#: named by itself, which lets Java look it up in a table.
BETWEEN = "[" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isdigit() and not chr(c).islower() and chr(c) != "\n") + "]+"

#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: The notices that the method looks for, as (label, words).
TEMPLATES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
]


def _lowered(text: Column) -> Column:
    """A-Z in lower case. lower() also changes letters outside ASCII, which is of no account to the words below,
    but for the two that it turns into ASCII."""
    odd = text.contains("\u212a") | text.contains("\u0130")  # Kelvin sign, I with dot
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _cut(docs: DataFrame, known: list[str]) -> DataFrame:
    """Of docs (id, text in lower case): row (a number), id, n_tokens and held (i, w): where known words and ends of
    lines stand among all words and ends of lines."""
    tokens = F.array_remove(F.split(F.replace("text", F.lit("\n"), F.lit(" \n ")), BETWEEN, -1), "")
    cut = docs.select("id", tokens.alias("tokens"))
    places = F.array_compact(F.transform("tokens", lambda w, i: F.when(w.isin("\n", *known), i)))
    held = F.transform(places, lambda i: F.struct(i.alias("i"), F.get("tokens", i).alias("w")))
    found = cut.select(F.monotonically_increasing_id().alias("row"), "id", F.size("tokens").cast("long").alias("n_tokens"), held.alias("held"))
    return written(found, "license-words")  # so that texts are cut once, and rows keep their numbers


def _ends() -> Column:
    """Indexes in held of ends of lines, and of its own end."""
    marks = F.filter(F.transform("held", lambda x, j: F.when(x["w"] == "\n", j)), lambda j: j.isNotNull())
    return F.concat(marks, F.array(F.size("held")))


def _by_lines(of_line) -> Column:
    """of_line(what held has of a line, the line's number) for all lines, from `ends`."""

    def line(end: Column, b: Column) -> Column:
        start = F.coalesce(F.get("ends", b - 1) + 1, F.lit(0))
        return of_line(F.slice("held", start + 1, end - start), b)

    return F.transform("ends", line)


def _placed() -> Column:
    """held without ends of lines: where known words (w) stand among all words (i)."""
    return F.flatten(_by_lines(lambda held, b: F.transform(held, lambda x: F.struct((x["i"] - b).alias("i"), x["w"].alias("w")))))


def _starts(phrase: str) -> Column:
    """Where in `placed` the phrase's words stand one after another: indexes of its first word."""
    parts = phrase.split(" ")

    def begins(x: Column, j: Column) -> Column:
        hit = x["w"] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            after = F.get("placed", j + k)
            hit = hit & (after["w"] == part) & (after["i"] == x["i"] + k)
        return hit

    return F.transform(F.filter("placed", begins), lambda x: x["i"])


def _phrases(cut: DataFrame) -> DataFrame:
    """row, at0, at1 ...: where each phrase begins, for the texts that hold all words of one."""
    held = [reduce(and_, [F.array_contains("held.w", w) for w in set(p.split())]) for p in PHRASES]
    texts = cut.filter(reduce(or_, held)).select("row", "held", _ends().alias("ends")).select("row", _placed().alias("placed"))
    return texts.select("row", *[_starts(p).alias(f"at{k}") for k, p in enumerate(PHRASES)])


class _Join:
    """Templates as word sets, with the global order of their words by their frequencies in all texts."""

    def __init__(self, cut: DataFrame, templates: list[tuple[str, str]], threshold: float):
        sets = [(label, sorted(set(words.split())), len(words.split())) for label, words in templates]
        known = sorted({w for _, words, _ in sets for w in words})
        counted = cut.select(F.explode("held.w").alias("word")).groupBy("word").count().filter(F.col("word").isin(known))
        counts = {r["word"]: r["count"] for r in counted.collect()}  # a row for each of the templates' words at most
        self.order = sorted(known, key=lambda w: (counts.get(w, 0), w))
        rank = {w: k for k, w in enumerate(self.order)}
        self.prefixes, self.least = [], len(known) + 1
        for k, (label, words, length) in enumerate(sets):
            ranks, need = sorted(rank[w] for w in words), needed(len(words), threshold)
            self.least = min(self.least, need)
            self.prefixes += [(self.order[r], r, k, i, len(words), need, length, label, ranks, words) for i, r in enumerate(ranks[: len(words) - need + 1])]

    def rare(self) -> Column:
        """The words of all prefixes: a block or text that holds none of them is no candidate."""
        return F.array(*map(F.lit, sorted({p[0] for p in self.prefixes}))).cast("array<string>")

    def covered(self, blocks: DataFrame) -> DataFrame:
        """Blocks (with `words`, distinct) that a template covers, once for each such template."""
        # Its size is fixed by the templates, so this side can be broadcast.
        prefix = F.broadcast(blocks.sparkSession.createDataFrame(self.prefixes, "word string, rank int, template int, i int, size int, need int, length int, label string, whole array<int>, of_template array<string>"))
        # explode_outer: for explode, Spark would filter by the exploded column's expression, that is make it twice.
        near = blocks.withColumn("word", F.explode_outer(F.array_intersect("words", self.rare()))).join(prefix, "word")
        order = F.array(*map(F.lit, self.order))
        # Ends of lines and words that only phrases have are at no place of the order.
        ranks = F.filter(F.transform("words", lambda w: (F.array_position(order, w) - 1).cast("int")), lambda r: r >= 0)
        near = near.withColumn("set", ranks).withColumn("n", F.size("set")).withColumn("j", F.size(F.filter("set", lambda r: r < F.col("rank"))))
        near = near.filter((F.col("n") >= F.col("need")) & (F.col("j") <= F.col("n") - F.col("need")))
        near = near.filter(F.least(F.col("size") - F.col("i"), F.col("n") - F.col("j")) >= F.col("need"))
        common = F.array_intersect("set", "whole")
        # Their first common word is in both prefixes, so it tells each pair once.
        return near.filter((F.size(common) >= F.col("need")) & (F.array_min(common) == F.col("rank"))).withColumn("common", F.size(common))


def needed(size: int, threshold: float) -> int:
    return math.ceil(round(threshold * size, 9))


def _near(join: _Join, cut: DataFrame) -> DataFrame:
    """The texts that hold a word of a prefix; blocks of others are no candidates."""
    return written(cut.filter(F.arrays_overlap("held.w", join.rare())).select("row", "id", "held"), "license-near")


def _by_line(join: _Join, near: DataFrame) -> DataFrame:
    texts = near.select("row", "id", "held", _ends().alias("ends"))
    sets = _by_lines(lambda held, b: F.struct(b.alias("block"), F.array_distinct(held["w"]).alias("words")))
    lines = F.filter(sets, lambda x: F.size(x["words"]) >= join.least)
    found = join.covered(texts.select("row", "id", F.inline_outer(lines)))
    return found.select("row", "id", "block", "label", (F.col("common") / F.col("size")).alias("containment"))


def _by_window(join: _Join, near: DataFrame) -> DataFrame:
    """row, label, containment for every text and template that covers one of its windows: the most that any has."""
    texts = near.withColumn("words", F.array_distinct("held.w"))
    texts = join.covered(texts).select("row", "label", "size", "need", "length", "of_template", "held", _ends().alias("ends")).withColumn("placed", _placed())
    # Windows that begin with a word of the template are enough, and none has more of them than it has words.
    texts = texts.withColumn("places", F.filter("placed", lambda x: F.array_contains("of_template", x["w"])))
    # Few texts are left; written, so that the filter below isn't pushed into the making of its columns.
    texts = written(texts.select("row", "label", "size", "need", "length", "places"), "license-windows")
    from_each = F.transform(
        "places",
        lambda x, j: F.size(F.array_distinct(F.transform(F.filter(F.slice("places", j + 1, F.col("length")), lambda y: y["i"] < x["i"] + F.col("length")), lambda y: y["w"]))),
    )
    found = texts.withColumn("common", F.array_max(from_each)).filter(F.col("common") >= F.col("need"))
    return found.select("row", "label", (F.col("common") / F.col("size")).alias("containment"))


def matched_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """Of docs (id, text in lower case): row, id, block, label, containment for every line (block, from 0) that a
    template covers, once for each such template."""
    cut = _cut(docs, sorted({w for _, words in templates for w in words.split()}))
    join = _Join(cut, templates, threshold)
    return _by_line(join, _near(join, cut))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.9, wrapped: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the base phrases, first_word and last_word are the smallest and the largest word
    index that one begins at. labels adds the labels of the templates that cover a block: a line or, with wrapped, a
    window of words as well. score is 1 if a base phrase was found, else the largest containment of a covering
    template, else 0.

    * A null text counts as the empty text: no words, no labels (the empty string), score 0.
    * Rows that repeat an id, or have none, are each judged by their own text.
    * Other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _lowered(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    cut = _cut(texts, sorted({w for _, words in templates for w in words.split()} | {w for p in PHRASES for w in p.split()}))
    join = _Join(cut, templates, threshold)
    near = _near(join, cut)
    matched = _by_line(join, near).select("row", "label", "containment")
    if wrapped:
        matched = matched.unionByName(_by_window(join, near))
    by_row = matched.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))

    n_words = F.col("n_tokens") - F.size(F.filter("held", lambda x: x["w"] == "\n"))
    none = F.array().cast("array<int>")
    at = [F.coalesce(f"at{k}", none).alias(f"at{k}") for k in range(len(PHRASES))]
    placed = cut.select("row", "id", n_words.alias("n_words")).join(_phrases(cut), "row", "left").select("row", "id", "n_words", *at)
    labelled = F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])
    base = placed.select("row", "id", "n_words", F.concat(*[f"at{k}" for k in range(len(PHRASES))]).alias("at"), F.array_sort(F.array_distinct(F.array_compact(labelled))).alias("base"))
    all_labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return base.join(by_row, "row", "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
