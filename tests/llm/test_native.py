"""Exact and line de-duplication and the license scan on hand-made rows, and against their SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm.exact_dedup import exact_dedup
from ledgerfold.llm.license_scan import TEMPLATES, license_scan, matched_blocks
from ledgerfold.llm.line_dedup import line_dedup
from ledgerfold.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_every_query_matches_its_sql(spark, name):
    out = QUERIES[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(out.columns)) for r in out.collect()), key=str)
    base = duckdb.connect()
    for table in ("documents", "pages"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = base.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(out.columns)
    assert got == sorted((tuple(r[names.index(c)] for c in sorted(out.columns)) for r in result.fetchall()), key=str)


ROWS = [(4, "a b", 1), (2, "ab", 1), (9, "a  b", 2), (7, "\na\tb\r", 2), (7, "\na\tb\r", 2), (1, None, 3), (3, " \n", 3), (5, "x" * 50_000, 4), (None, "y", 5), (6, "y", 5), (None, " z ", 6), (8, "z", 6), (11, "a b", 7)]


def expected():
    groups = defaultdict(list)
    for doc_id, text, _ in ROWS:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = Counter()
    for doc_id, text, _ in ROWS:
        content = re.sub("[\x20\x09-\x0d]", "", text or "")
        best = min(groups[content], key=lambda x: (x[0], x[1], x[2] or 0))
        out[doc_id, best[2], len(groups[content]), doc_id == best[2] and -len(text or "") == best[0], hashlib.sha256(content.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("digest", ["sha256", "one for all", "length"])
def test_exact_dedup_compares_contents(spark, digest):
    weak = {"sha256": {}, "one for all": {"digest": lambda c: F.lit("x")}, "length": {"digest": lambda c: F.length(c).cast("string")}}[digest]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest int").repartition(3)
    got = exact_dedup(docs, **weak).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == expected()
    assert exact_dedup(docs.limit(0), **weak).count() == 0


def test_line_dedup_cases(spark):
    line = "This Line is long enough to be counted as SHARED."
    rows = [(k, f"own {k}\n  {line}\t\nend\n{line.upper()}", 0) for k in range(5)] + [(None, f"{line}\nx", 1), (7, None, 2), (8, "", 3), (8, "", 3), (9, "short\n" * 3000, 4), (3, f"{line}\nother text of the same id", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __pos int")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup(docs).collect())
    want = Counter({(k, 4, 2, f"own {k}\nend"): 1 for k in range(4)})
    want += Counter([(4, 4, 0, rows[4][1]), (None, 2, 1, "x"), (7, 1, 0, ""), (8, 1, 0, ""), (8, 1, 0, ""), (9, 3001, 0, rows[9][1]), (3, 2, 1, "other text of the same id")])
    assert got == want
    assert line_dedup(docs.limit(0)).count() == 0
    assert line_dedup(docs, keep_columns=True).columns == ["doc_id", "text", "__pos", "__n_lines", "__n_dropped"]
    few = docs.filter("doc_id in (0, 1, 2, 3)")
    assert line_dedup(few).agg(F.sum("n_dropped")).head()[0] == 0


def test_line_keys_lower_only_ascii(spark):
    upper, lower = "É" + "a" * 50, "é" + "A" * 50
    rows = [(k, upper) for k in range(4)] + [(9, lower)]
    assert line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped")).head()[0] == 0
    rows += [(10, "É" + "A" * 50)]
    assert line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped")).head()[0] == 4


def test_license_scan_cases(spark):
    rows = [
        (1, "x\nReleased UNDER the MIT-License. under the mit license", 0), (2, None, 0), (3, "", 1), (4, "All rights\nreserved", 2), (5, "reserved: all the rights", 3),
        (6, "apache license version 2 cc-by-nc cc by nc", 4), (6, "apache license version 2 cc-by-nc cc by nc", 4), (None, "CC BY NC", 5), (7, "word " * 20_000 + "under the mit license", 6),
        (8, "Redistribution and use in source and binary forms, with or without modification, permitted", 7), (9, "under the mité license", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 3)) for r in license_scan(docs).collect())
    want = Counter([
        (1, 10, 2, 2, 6, "mit", "mit", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 3, 0, None, None, "", "", 0.0), (5, 4, 0, None, None, "", "all-rights-reserved", 1.0),
        (6, 10, 3, 0, 7, "apache-2,cc-by-nc", "apache-2,cc-by-nc", 1.0), (6, 10, 3, 0, 7, "apache-2,cc-by-nc", "apache-2,cc-by-nc", 1.0), (None, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 1.0),
        (7, 20_004, 1, 20_000, 20_000, "mit", "mit", 1.0), (8, 13, 0, None, None, "", "bsd", round(12 / 13, 3)), (9, 4, 0, None, None, "", "", 0.0),
    ])
    assert got == want
    assert license_scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9, 1.0])
def test_set_join_is_that_of_all_pairs(spark, threshold):
    import math
    import random

    rng = random.Random(int(threshold * 10))
    vocabulary = [f"w{k}" for k in range(30)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randrange(1, 9)))) for k in range(12)]
    lines = [" ".join(rng.choice(vocabulary[: rng.choice([5, 30])]) for _ in range(rng.randrange(12))) for _ in range(300)]
    docs = spark.createDataFrame([(k, str(k), "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(30)], "id long, text_key string, text string")
    got = Counter((r.id * 10 + r.block, r.label, round(r.containment, 6)) for r in matched_blocks(docs, templates, threshold).collect())
    want = Counter()
    for n, line in enumerate(lines):
        for label, words in templates:
            of_template = set(words.split())
            common = len(of_template & set(line.split()))
            if common >= math.ceil(round(threshold * len(of_template), 9)):
                want[n, label, round(common / len(of_template), 6)] += 1
    assert got == want


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted"
GPL = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License\n * version 3"


def test_wrapped_notices_are_found(spark):
    rng = random.Random(4)
    pool = sorted({w for _, t in TEMPLATES for w in t.split()}) + ["other"] * 30
    texts = [MIT, BSD, GPL, "All rights\nreserved", "all\n" + "x " * 9 + "rights\nreserved", None, "the " * 3000 + MIT + " of" * 3000]
    for _ in range(80):
        words = (rng.choices(pool, k=15) + rng.choice(TEMPLATES)[1].split() + rng.choices(pool, k=15))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(15, len(words) - 15)] = rng.choice(pool)
        texts.append("".join(w + rng.choice(" \n") for w in words))

    def labels(text):
        found = {"mit"} if "under the mit license" in (flat := " ".join(re.findall("[a-z0-9]+", (text or "").lower()))) else set()
        found |= {label for phrase, label in (("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) if phrase in flat}
        blocks = [[re.findall("[a-z0-9]+", line) for line in (text or "").lower().split("\n")], flat.split()]
        for label, template in TEMPLATES:
            whole, n = set(template.split()), len(template.split())
            windows = blocks[0] + [blocks[1][k : k + n] for k in range(len(blocks[1]))]
            if any(len(whole & set(w)) >= 0.9 * len(whole) - 1e-9 for w in windows):
                found.add(label)
        return ",".join(sorted(found))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.labels for r in license_scan(docs, wrapped=True).collect()}
    assert [got[k] for k in range(7)] == ["mit", "bsd", "gpl-3", "all-rights-reserved", "", "", "mit"]
    assert got == dict(enumerate(map(labels, texts)))
