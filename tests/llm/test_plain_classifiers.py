"""The three classifiers against plain versions: dictionaries, one text, one n-gram and one coordinate at a time."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerfold.llm import ftrl, language_id, quality, textarrays, toxicity
from ledgerfold.llm.textarrays import text_bytes

MASK = (1 << 64) - 1
SF = "/root/testdata/sf0.01"


def slot(chars, n, bits):
    h = n * 0x51ED27
    for c in chars:
        h = (h * 0x9FB21C651E98DF25 + ord(c)) & MASK
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & MASK
    return h >> (64 - bits)


def grams(text, n, bits):
    return [slot(text[k : k + n], n, bits) for k in range(len(text) - n + 1)]


def folded(text):
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    return "".join(low(c) if c.isalpha() else " " for c in text or "")


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def word_hash(word):
    total = len(word) * 0xE7037ED1A0B428DB
    for k, byte in enumerate(word):
        x = int(textarrays._BYTE[byte]) ^ mixed(k + 0x9E3779B97F4A7C15 & MASK)
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
        total += x ^ x >> 29
    return mixed(total & MASK)


def plain_ftrl(rows, y, classes, *, alpha, beta, l1, l2, epochs):
    z, n = defaultdict(lambda: [0.0] * classes), defaultdict(lambda: [0.0] * classes)
    zb, nb, bias = [0.0] * classes, [0.0] * classes, [0.0] * classes

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            w = {i: [weight(i, c) for c in range(classes)] for i in rows[k]}
            logits = [bias[c] + sum(x * w[i][c] for i, x in rows[k].items()) for c in range(classes)]
            e = [math.exp(v - max(logits)) for v in logits]
            p = [v / sum(e) - (c == y[k]) for c, v in enumerate(e)]
            for i, x in rows[k].items():
                for c in range(classes):
                    g = x * p[c]
                    z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha * w[i][c]
                    n[i][c] += g * g
            for c in range(classes):
                zb[c] += p[c] - (math.sqrt(nb[c] + p[c] ** 2) - math.sqrt(nb[c])) / alpha * bias[c]
                nb[c] += p[c] ** 2
                bias[c] = -zb[c] / ((beta + math.sqrt(nb[c])) / alpha)
    return {i: [weight(i, c) for c in range(classes)] for i in z}, bias


@pytest.fixture(scope="module")
def documents(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.doc_id in labels and r.text and len(r.text) < 900]
    chosen = [r for r in rows if labels[r.doc_id].toxic][:12] + [r for r in rows if not labels[r.doc_id].quality][:12] + rows[:30]
    return [(r.text, r.lang, labels[r.doc_id]) for r in {r.doc_id: r for r in chosen}.values()]


OTHER = ["", None, "1 2 3", "Été #% ok ok", "\nİx  y\n", "日本語 text"]


def test_toxicity(documents):
    texts, toxic = [t for t, _, _ in documents], [bool(x.toxic) for _, _, x in documents]
    model = toxicity.fit(pa.array(texts), np.array(toxic))
    held = [{s for n in toxicity.ORDERS for s in grams(folded(t), n, toxicity.BITS)} for t in texts]
    n, count = Counter(toxic), {c: Counter(s for h, y in zip(held, toxic, strict=True) if y == c for s in h) for c in (False, True)}
    ratio, sure = {}, {}
    for s in set(count[False]) | set(count[True]):
        a, b = count[False][s], count[True][s]
        ratio[s] = math.log((b + 1) / (n[True] + 2)) - math.log((a + 1) / (n[False] + 2))
        spread = math.sqrt(1 / (a + 1) - 1 / (n[False] + 2) + 1 / (b + 1) - 1 / (n[True] + 2))
        sure[s] = abs(ratio[s]) / spread if a + b >= 2 else 0
    best = sorted(s for s in sorted(sure, key=lambda s: (-round(sure[s], 9), s))[:2048] if sure[s] > 2)
    assert best == model.slots.tolist()
    x = np.array([[ratio[s] if s in h else 0 for s in best] for h in held], np.float32)
    w, bias = toxicity.logistic(x, np.array(toxic, np.float32), np.array([0.5 / n[y] for y in toxic]), 1e-4)
    assert np.allclose(model.weights, [w[k] * ratio[s] for k, s in enumerate(best)], atol=1e-5)
    weight = dict(zip(best, model.weights.tolist(), strict=True))
    plain = [1 / (1 + math.exp(-model.bias - sum(weight.get(s, 0) for s in {s for n in toxicity.ORDERS for s in grams(folded(t), n, toxicity.BITS)}))) for t in texts + OTHER]
    assert model.scores(*text_bytes(pa.array(texts + OTHER, pa.string()))) == pytest.approx(plain, abs=1e-6)


def test_logistic_is_at_the_minimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5))
    y = (x @ [1, -2, 0, 0.5, 1] + rng.normal(size=80) > 0).astype(float)
    weight = rng.random(80) + 0.1
    w, bias = toxicity.logistic(x, y, weight, 1e-2, steps=3000)
    loss = lambda v: (weight / weight.sum() * np.log1p(np.exp(-(2 * y - 1) * (x @ v[:5] + v[5])))).sum() + 0.5e-2 * (v[:5] ** 2).sum()
    found = np.append(w, bias)
    assert all(loss(found) <= loss(found + d) + 1e-9 for d in rng.normal(size=(200, 6)) * 0.01)


def test_language(documents):
    texts, langs = [t for t, _, _ in documents], [lang or "xx" for _, lang, _ in documents]
    model = language_id.fit(pa.array(texts), langs)
    names = sorted(set(langs))
    counts = [Counter(s for n in language_id.ORDERS for s in grams(folded(t), n, language_id.BITS)) for t in texts]
    out = np.random.default_rng(1).permutation(len(texts)) % 5 == 0
    df = Counter(s for c, o in zip(counts, out, strict=True) if not o for s in c)
    idf = lambda s: math.log((1 + (~out).sum()) / (1 + df[s])) + 1
    rows = [{s: k / max(1, c.total()) * idf(s) for s, k in c.items()} for c in counts]
    y = [names.index(lang) for lang in langs]
    w, bias = plain_ftrl([r for r, o in zip(rows, out, strict=True) if not o], [k for k, o in zip(y, out, strict=True) if not o], len(names), alpha=2.0, beta=0.01, l1=2e-3, l2=1e-3, epochs=4)
    logits = lambda t: [bias[c] + sum(k / max(1, f.total()) * idf(s) * w[s][c] for s, k in f.items() if s in w) for c in range(len(names))] if (f := Counter(s for n in language_id.ORDERS for s in grams(folded(t), n, language_id.BITS))) else bias
    held = [k for k in range(len(texts)) if out[k]]
    temperature = language_id._temperature(np.array([logits(texts[k]) for k in held]), np.array([y[k] for k in held]))
    assert model.temperature == pytest.approx(temperature, rel=1e-4)
    index, score = language_id.predict(model.model.table(language_id.BITS, np.float64), model.model.bias, model.temperature, *text_bytes(pa.array(texts + OTHER, pa.string())))
    for t, got, p in zip(texts + OTHER, index, score, strict=True):
        e = np.exp(np.array(logits(t)) / model.temperature - max(logits(t)) / model.temperature)
        if any(c.isalpha() for c in t or ""):
            assert p == pytest.approx(max(e) / sum(e), abs=1e-6) and e[got] == pytest.approx(max(e), abs=1e-6)
        else:
            assert (got, p) == (-1, 0)


def test_quality(documents):
    texts, good = [t for t, _, _ in documents], [int(x.quality) for _, _, x in documents]
    model = quality.fit(pa.array(texts), np.array(good))

    def features(text):
        words = [word_hash(w) for w in re.findall(b"[^\x20\x09-\x0d]+", (text or "").encode())]
        lists = [grams(text or "", n, quality.BITS) for n in quality.ORDERS] + [[h >> (64 - quality.BITS) for h in words], [mixed((a * 3 + b) & MASK) >> (64 - quality.BITS) for a, b in zip(words, words[1:], strict=False)]]
        row = defaultdict(float)
        for own in lists:
            for s in own:
                row[s] += 1 / len(own)
        return row

    rows = [features(t) for t in texts]
    out = np.random.default_rng(1).permutation(len(texts)) % 5 == 0
    w, bias = plain_ftrl([r for r, o in zip(rows, out, strict=True) if not o], [k for k, o in zip(good, out, strict=True) if not o], 2, alpha=2.0, beta=0.01, l1=1e-3, l2=1e-3, epochs=4)
    margin = lambda t: bias[1] - bias[0] + sum(x * (w[s][1] - w[s][0]) for s, x in features(t).items() if s in w)
    held = [k for k in range(len(texts)) if out[k]]
    slope, shift = quality.platt(np.array([margin(texts[k]) for k in held]), np.array([good[k] for k in held]))
    assert (model.slope, model.shift) == pytest.approx((slope, shift), rel=1e-5, abs=1e-5)
    got = quality.margins(model.model.table(quality.BITS, np.float64)[:, 0], float(model.model.bias[0]), *text_bytes(pa.array(texts + OTHER, pa.string())))
    assert got == pytest.approx([margin(t) for t in texts + OTHER], abs=1e-6)


def test_platt_is_at_the_minimum():
    rng = np.random.default_rng(2)
    m = rng.normal(size=200) * 3
    y = (m + rng.normal(size=200) * 2 > 1).astype(int)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda a, b: (np.log1p(np.exp(a * m + b)) - target * (a * m + b)).sum() + 0.5e-3 * (a - 1) ** 2
    a, b = quality.platt(m, y)
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-9 for d, e in rng.normal(size=(100, 2)) * 0.01)


def test_sparse_fit_is_the_plain_one():
    rng = np.random.default_rng(6)
    rows = [{int(s): float(v) for s, v in zip(rng.choice(50, 8, replace=False), rng.random(8), strict=True)} for _ in range(60)]
    y = rng.integers(0, 3, 60)
    w, bias = plain_ftrl(rows, y, 3, alpha=1.0, beta=1.0, l1=0.05, l2=0.01, epochs=2)
    model = ftrl.fit([(np.array(sorted(r)), np.array([r[s] for s in sorted(r)])) for r in rows], y, 3, 6, alpha=1.0, l1=0.05, l2=0.01)
    assert model.bias == pytest.approx(bias) and model.table(6, np.float64)[sorted(w)] == pytest.approx(np.array([w[s] for s in sorted(w)]))
