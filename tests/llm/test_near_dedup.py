"""Near-duplicates against all pairs, signatures against the similarity that they estimate."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from test_classifiers import twins

from ledgerfold.llm import near_dedup as module
from ledgerfold.llm.bagminhash import bags, shingles, signatures, weighted_jaccard
from ledgerfold.llm.components import components
from ledgerfold.llm.near_dedup import near_dedup
from ledgerfold.llm.textarrays import text_bytes


def bag(text):
    words = text.encode().lower().split() if text else []
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def similar(a, b):
    least = sum((a & b).values())
    return least / (sum(a.values()) + sum(b.values()) - least)


def brute(rows, threshold=0.8):
    """{id: least id of its class} by all pairs."""
    bags_of, above = [(k, bag(t)) for k, t in rows], {k: k for k, _ in rows}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, (k, a) in enumerate(bags_of):
        for m, b in bags_of[:i]:
            if (not a and not b) or (a and b and similar(a, b) >= threshold):
                p, q = sorted((find(k), find(m)))
                above[q] = p
    return {k: find(k) for k in above}


def corpus(seed, groups=6, copies=40, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words if g else 8)]
        for _ in range(copies if g < 3 else 3):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(30)]
    rows += [" ".join(["again"] * n) for n in (3, 5, 30, 31, 33, 60)] + ["", " \n", "a b", "A  b", "a b c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("margin", [module.MARGIN, 1.0])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, seed, margin):
    rows = corpus(seed)
    monkeypatch.setattr(module, "BLOCK", 7)
    docs = spark.createDataFrame([(k, t, k) for k, t in rows], "doc_id long, text string, component long").repartition(5)
    got = {r.doc_id: r.class_id for r in near_dedup(docs, margin=margin).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "alone x"), (7, None), (8, ""), (9, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.kept) for r in near_dedup(docs).collect())
    assert got == Counter([(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (7, 7, True), (8, 7, False), (9, 9, True)])
    assert near_dedup(docs.limit(0)).count() == 0


def test_rows_are_known_by_their_texts(spark):
    a, b = twins(11)
    rows = [(1, f"{a} q r s t"), (2, f"{b} q r s t"), (3, "x y z u v w"), (3, "one two three four five"), (4, "one two three four five"), (2, "X Y  z u v w")]
    rows += [(None, "only nulls have this one"), (None, "Only nulls have this  one"), (None, None), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.class_id, r.kept) for r in near_dedup(docs).collect())
    assert got == Counter([(1, 1, True), (2, 2, True), (3, 2, False), (2, 2, True), (3, 3, True), (4, 3, False), (None, None, True), (None, None, False), (None, 6, False), (6, 6, True)])
    keyed = near_dedup(docs, with_text_hash=True)
    assert keyed.columns == ["doc_id", "text_hash", "class_id", "kept"] and keyed.count() == len(rows)


def test_large_weights_cost_their_points():
    rng = np.random.default_rng(5)
    e = rng.integers(0, 1 << 52, 3).astype(np.uint64)
    owner, weight = np.repeat([0, 1], 3), np.array([1_000_000, 3, 700, 600_000, 3, 700])
    s = signatures(owner, np.concatenate([e, e]), weight, 2, 4096)
    j = (600_000 + 703) / (1_000_000 + 703)
    assert abs((s[0] == s[1]).mean() - j) < 4 * np.sqrt(j * (1 - j) / 4096)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    for _ in range(4):
        a = rng.integers(0, 9, 50)
        b = np.where(rng.random(50) < 0.6, a, rng.integers(0, 30, 50))
        a[0] = b[0] = 50
        e = rng.integers(0, 1 << 52, 50).astype(np.uint64)
        owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = signatures(owner, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 8192)
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - j) < 4 * np.sqrt(j * (1 - j) / 8192)


def test_weighted_jaccard_is_that_of_the_shingles():
    for _, t in corpus(5)[:20]:
        for _, u in corpus(5)[:20]:
            data, at = text_bytes(pa.array([t, u]))
            _, _, h, places = shingles(data, at)
            owner, element, weight = bags(h, places)
            x, y = (np.repeat(element[owner == k], weight[owner == k]) for k in (0, 1))
            if len(x) and len(y):
                assert weighted_jaccard(x, y) == pytest.approx(similar(bag(t), bag(u)))


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (7, 7), (200, 300), (300, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
