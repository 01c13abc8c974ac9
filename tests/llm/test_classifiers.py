"""Classifiers on held-out rows, base rules against brute force, and the cases that rows can be."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerfold.llm import ftrl, language_id, quality, toxicity
from ledgerfold.llm.quality import numbered
from ledgerfold.llm.queries_classifiers import op1_quality_rules, op4_language_id, op8_toxicity
from ledgerfold.llm.textarrays import code_points, distinct_spans, gram_slots, slices, span_hashes, sums_by_text, text_bytes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), repeated, len(covered)


ODD = [None, "", " \n\t", "a", "a a a a", "a b c\na b c\n\n \na b c", "x\r\nx\r\n", "日本 語#|é b", "one\n one\none ", "a b a b a b"]


def test_base_counts_are_exact(documents):
    texts = ODD + [r.text for r in list(documents.values())[:300]]
    data, at = text_bytes(pa.array(texts, pa.string()))
    got = []
    for i, j in slices(at, 500):
        counts = quality.base_counts(data[at[i] : at[j]], at[i : j + 1] - at[i])
        got += list(zip(*[counts[c].tolist() for c in quality.COUNTS], strict=True))
    assert got == [plain_counts(t) for t in texts]


def test_quality_keeps_the_good(spark, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in op1_quality_rules(spark, SF).collect()}
    assert set(rows) == set(documents)
    for k, r in rows.items():
        n, chars, symbols, lines, repeated = plain_counts(documents[k].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and 0 <= r.quality <= 1
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    judged = [k for k in labels if not rows[k].base_failed]
    assert np.mean([rows[k].kept == bool(labels[k]) for k in judged]) > 0.97


def test_languages_of_held_out_documents(spark, documents):
    rows = op4_language_id(spark, SF).collect()
    assert len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == documents[r.doc_id].lang for r in held]) > 0.97


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op8_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in judged]) > 0.9


def test_rows_of_every_kind(spark):
    rows = [(k, t, "x", 0, 0.5) for k, t in enumerate(ODD)] + [(None, "text without id", "x", 1, 1.0), (1, "same", None, None, None), (1, "same", None, None, None), (3, "long word " * 30_000, "y", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __SCORE int, __text double").repartition(3)
    labels = spark.createDataFrame([(0, 1, 1), (4, 0, 0), (4, 1, 0), (None, 1, 1), (5, None, None), (3, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for of_labels in (labels, labels.limit(0), labels.filter("doc_id = 4")):
        scored = toxicity.toxicity(docs, toxicity.train(docs, of_labels)).collect()
        assert len(scored) == len(rows) and all(0 <= r.__getitem__("__score") <= 1 for r in scored)
        assert Counter(r["__text"] for r in scored) == Counter(r[4] for r in rows)
        judged = quality.quality_rules(docs, quality.train(docs, of_labels)).collect()
        assert len(judged) == len(rows) and all(0 <= r.quality <= 1 for r in judged)
    for of_docs in (docs, docs.filter("lang is null"), docs.limit(0)):
        model = language_id.train(of_docs)
        named = language_id.language_id(docs, model).collect()
        assert len(named) == len(rows) and all(r["__lang_pred"] == "und" and r["__score"] == 0 for r in named if not re.search(r"[^\W\d_]", r.text or ""))
        assert {r["__lang_pred"] for r in named} <= {*model.languages, "und"}
    assert toxicity.toxicity(docs.limit(0), toxicity.train(docs, labels)).count() == 0
    assert language_id.language_id(docs.limit(0), language_id.train(docs)).count() == 0
    assert quality.quality_rules(docs.limit(0), quality.train(docs, labels)).count() == 0


def test_penalties_leave_few_weights():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for k in range(400):
        slots = np.unique(rng.integers(0, 1 << 10, 20))
        x = np.ones(len(slots)) / 20
        y.append(k % 2)
        rows.append((np.append(slots, 2000 + k % 2), np.append(x, 0.5)))
    model = ftrl.fit(rows, np.array(y), 2, 12, alpha=1.0, l1=0.5, l2=0.01)
    assert len(model.slots) < 50 and {2000, 2001} <= set(model.slots.tolist())


def twins(n):
    """Two words of 2 ** n letters that polynomial hashes modulo powers of two can't tell apart."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_lines_and_windows_are_compared_by_content():
    a, b = twins(11)
    texts = [f"{a}\n{b}", f"{a}\n{a}", f"x y {a} x y {b}", f"x {a} y\nx {a} y"]
    data, at = text_bytes(pa.array(texts))
    counts = quality.base_counts(data, at)
    assert list(zip(*[counts[c].tolist() for c in quality.COUNTS], strict=True)) == [plain_counts(t) for t in texts]
    starts, ends, _ = quality.word_spans(data, at)
    first, which = distinct_spans(data, starts, ends, np.zeros(len(starts), np.uint64))  # all hashes alike
    words = [data[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]
    assert [words[first[k]] for k in which] == words and len(first) == len(set(words)) == 4
    assert len(set(span_hashes(data, starts, ends).tolist())) == 4


def test_rows_are_numbered_exactly():
    rng = np.random.default_rng(3)
    for top in (3, 1 << 25, 1 << 40):
        columns = [rng.integers(0, 3, 200) * top for _ in range(4)]
        rows = list(zip(*columns, strict=True))
        got = numbered(*columns).tolist()
        assert len(set(got)) == len(set(rows)) == len({(g, r) for g, r in zip(got, rows, strict=True)})


def test_text_arrays():
    texts = ["abc", "", "éaé", "bcé日", "abcabc"]
    data, at = text_bytes(pa.array(texts))
    points, places = code_points(data, at)
    assert [points[a:b].tolist() for a, b in zip(places[:-1], places[1:])] == [[ord(c) for c in t] for t in texts]
    slots, whole = gram_slots(points, places, 3, 20)
    assert sums_by_text(whole, places).tolist() == [1, 0, 1, 2, 4]
    assert slots[places[0]] == slots[places[4]] == slots[places[4] + 3] != slots[places[2]]
    h = span_hashes(data, at[:-1], at[1:])
    assert len(set(h.tolist())) == 5 and span_hashes(data, at[4:5] + 3, at[5:6])[0] == h[0]
