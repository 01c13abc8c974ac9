"""Quality rules: a calibrated logistic regression on hashed word and character n-grams, behind fixed base rules.

Features are the relative frequencies of hashed character n-grams (case and signs kept) and of hashed words and
pairs of words. The regression is trained on labelled rows; a logistic curve (Platt) fitted on a part that
training doesn't see turns its margins into probabilities, which are held against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .common import bounded_sample, ship
from .textarrays import code_points, distinct_spans, gram_slots, mix, slices, span_hashes, sums_by_text, text_bytes

ORDERS, BITS = (1, 2, 3), 17
#: Fixed values of the base rules.
MIN_WORDS, MOST_REPEATED, SYMBOLS = 50, 50, b"#*$%&|<>"
KEEP = 0.5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words (runs without [\\x20\\x09-\\x0D]) begin and end, and the places of each text's among them."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SPACE[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    texts_begin = at[:-1][np.diff(at) > 0]
    begins[texts_begin] = inside[texts_begin]
    ends = inside[:-1] & ~inside[1:]
    texts_end = at[1:][np.diff(at) > 0] - 1
    ends[texts_end] = inside[texts_end]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each row of the columns (not negative), equal for equal rows and for no others."""
    out, top = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        size = int(column.max(initial=0)) + 1
        if top * size >= 1 << 62:
            _, out = np.unique(out, return_inverse=True)
            top = len(out) + 1
        out, top = out * size + column, top * size
    return out


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(at) - 1
    starts, ends, places = word_spans(data, at)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & ~_SPACE[data], out=chars[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    out = {"n_words": np.diff(places), "word_chars": np.diff(chars[at]), "n_symbols": np.diff(symbols[at])}

    # Lines: those with a word, less the distinct ones of each text.
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    cut[1:] |= data == 0x0A
    edges = np.flatnonzero(cut)
    begin, end = edges[:-1], edges[1:].copy()
    end -= data[end - 1] == 0x0A  # a line without its own end
    has_word = chars[end] > chars[begin]
    begin, end = begin[has_word], end[has_word]
    text = np.searchsorted(at, begin, "right") - 1
    _, line = distinct_spans(data, begin, end)
    _, first = np.unique(numbered(text, line), return_index=True)
    out["n_dup_lines"] = np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)

    # Words in windows of three that the text holds twice or more.
    _, word = distinct_spans(data, starts, ends)
    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        owner = np.repeat(np.arange(n), np.diff(places))
        own = np.flatnonzero(owner[:-2] == owner[2:])
        _, inverse, counts = np.unique(numbered(owner[own], word[own], word[own + 1], word[own + 2]), return_inverse=True, return_counts=True)
        again = own[counts[inverse] > 1]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = sums_by_text(covered, places).astype(np.int64)
    return out


def _features(data: np.ndarray, at: np.ndarray):
    """(slots, weight of each place, places of each text) for characters of each order, words and pairs of words."""
    points, of_points = code_points(data, at)
    for n in ORDERS:
        slots, whole = gram_slots(points, of_points, n, BITS)
        yield slots, whole, of_points
    starts, ends, places = word_spans(data, at)
    words = span_hashes(data, starts, ends)
    yield (words >> np.uint64(64 - BITS)).astype(np.int64), np.ones(len(words), bool), places
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    same = np.ones(len(pairs), bool)
    last = places[1:] - 1
    same[last[(last >= 0) & (last < len(pairs))]] = False
    yield (pairs >> np.uint64(64 - BITS)).astype(np.int64), same, places


@dataclass(frozen=True)
class QualityModel:
    model: ftrl.SparseModel
    slope: float
    shift: float


def _rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    data, at = text_bytes(texts)
    rows = []
    for i, j in slices(at):
        text, slot, value = [], [], []
        for slots, whole, places in _features(data[at[i] : at[j]], at[i : j + 1] - at[i]):
            own = np.flatnonzero(whole)
            owner = np.repeat(np.arange(j - i), np.diff(places))[own]
            text.append(owner)
            slot.append(slots[own])
            value.append(1 / np.bincount(owner, minlength=j - i)[owner] if len(own) else np.zeros(0))
        both, inverse = np.unique(np.concatenate(text) << BITS | np.concatenate(slot), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate(value), len(both))
        bounds = np.searchsorted(both, np.arange(j - i + 1) << BITS)
        rows += [(both[a:b] & (1 << BITS) - 1, sums[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return rows


def margins(table: np.ndarray, bias: float, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.full(len(at) - 1, bias)
    for slots, whole, places in _features(data, at):
        out += sums_by_text(table[slots] * whole, places) / np.maximum(sums_by_text(whole, places), 1)
    return out


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities, with Platt's smoothed targets."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(texts: pa.Array, good: np.ndarray, *, alpha: float = 2.0, l1: float = 1e-3, l2: float = 1e-3) -> QualityModel:
    """The model of labelled texts. With one class only (or none) every probability is that class' smoothed share."""
    good = np.asarray(good, np.int64)
    rows = _rows(texts)
    n1, n = int(good.sum()), len(good)
    if n1 in (0, n):
        share = (n1 + 1) / (n + 2)
        return QualityModel(ftrl.SparseModel(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(1)), 1.0, float(np.log(share / (1 - share))))
    kept_out = np.random.default_rng(1).permutation(n) % 5 == 0
    learned = np.flatnonzero(~kept_out)
    two = ftrl.fit([rows[k] for k in learned], good[learned], 2, BITS, alpha=alpha, beta=0.01, l1=l1, l2=l2, epochs=4)
    model = ftrl.SparseModel(two.slots, two.weights[:, 1:] - two.weights[:, :1], two.bias[1:] - two.bias[:1])
    table = model.table(BITS, np.float64)[:, 0]
    held = np.flatnonzero(kept_out)
    return QualityModel(model, *platt(np.array([x @ table[s] + model.bias[0] for s, x in (rows[k] for k in held)]), good[held]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most_rows: int = 1500) -> QualityModel:
    """Learns from labelled rows: some most_rows of each class at most, chosen by the hash of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and id is not null").groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = F.broadcast(bounded_sample(known, "label", most_rows))  # some 2 * most_rows ids
    table = texts.join(chosen, "id").select("id", "text", "label").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    good = table["label"].to_numpy()
    model = fit(table["text"].combine_chunks(), good)
    everywhere = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(everywhere) < 2 or good.sum() in (0, len(good)):
        return model
    # The sample has as many rows of either class as it can; the shift puts back how common they are.
    shares = np.log(everywhere[1] / good.sum()) - np.log(everywhere[0] / (len(good) - good.sum()))
    return QualityModel(model.model, model.slope, model.shift + float(shares))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judged(model: QualityModel, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.model.table(BITS)[:, 0]
        bias = float(model.model.bias[0])
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for i, j in slices(at):
                part, places = data[at[i] : at[j]], at[i : j + 1] - at[i]
                counts = base_counts(part, places)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
                p = 1 / (1 + np.exp(-np.clip(model.slope * margins(table, bias, part, places) + model.shift, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS], pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep))],
                    names=["doc_id", *COUNTS, "base_failed", "quality", "kept"],
                )

    return run


def quality_rules(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", *, keep: float = KEEP) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, quality (the probability), kept.

    A null text counts as the empty one: no words, so the base rules fail it. A null id stays null; rows that
    repeat are each judged; other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_judged(model, keep), schema)
