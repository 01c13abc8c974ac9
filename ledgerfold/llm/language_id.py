"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of letters in lower case (all else is a space): relative frequencies times inverse
document frequencies of the training sample. Training is FTRL-proximal with elastic-net penalties; a temperature
fitted on a part of the sample that training doesn't see turns logits into probabilities. Executors score whole
texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ftrl
from .common import bounded_sample, ship
from .textarrays import code_points, gram_slots, slices, sums_by_text, text_bytes
from .toxicity import folded

ORDERS, BITS = (1, 2, 3), 17
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    model: ftrl.SparseModel  # weights hold the inverse document frequencies
    temperature: float


def _grams(data: np.ndarray, at: np.ndarray):
    points, places = code_points(data, at)
    points = folded(points)
    yield (points != 0x20).astype(np.float64), None, places
    for n in ORDERS:
        yield *gram_slots(points, places, n, BITS), places


def _frequencies(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    data, at = text_bytes(texts)
    rows = []
    for i, j in slices(at):
        text, slot = [], []
        for k, (slots, whole, places) in enumerate(_grams(data[at[i] : at[j]], at[i : j + 1] - at[i])):
            if k:
                own = np.flatnonzero(whole)
                text.append(np.repeat(np.arange(j - i), np.diff(places))[own])
                slot.append(slots[own])
        both, counts = np.unique(np.concatenate(text) << BITS | np.concatenate(slot), return_counts=True)
        bounds = np.searchsorted(both, np.arange(j - i + 1) << BITS)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows.append((both[a:b] & (1 << BITS) - 1, counts[a:b] / max(1, counts[a:b].sum())))
    return rows


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least mean log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(ftrl.softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-300).mean()
    low, high, part = np.log(0.02), np.log(50), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(texts: pa.Array, languages: list[str], *, alpha: float = 2.0, l1: float = 2e-3, l2: float = 1e-3) -> LanguageModel:
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], ftrl.SparseModel(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0)), 1.0)
    y = np.searchsorted(names, languages)
    rows = _frequencies(texts)
    kept_out = np.random.default_rng(1).permutation(len(rows)) % 5 == 0
    df = np.zeros(1 << BITS)
    for (slots, _), out in zip(rows, kept_out, strict=True):
        if not out:
            df[slots] += 1
    idf = np.log((1 + (~kept_out).sum()) / (1 + df)) + 1
    rows = [(slots, tf * idf[slots]) for slots, tf in rows]
    learned = [k for k in range(len(rows)) if not kept_out[k]]
    model = ftrl.fit([rows[k] for k in learned], y[learned], len(names), BITS, alpha=alpha, beta=0.01, l1=l1, l2=l2, epochs=4)
    table = model.table(BITS, np.float64)
    held = np.flatnonzero(kept_out)
    logits = np.array([x @ table[slots] + model.bias for slots, x in (rows[k] for k in held)]).reshape(len(held), len(names))
    scaled = ftrl.SparseModel(model.slots, model.weights * idf[model.slots, None], model.bias)
    return LanguageModel(names, scaled, _temperature(logits, y[held]))


def predict(table: np.ndarray, bias: np.ndarray, temperature: float, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the index of its language (-1: no letters) and the probability."""
    n = len(at) - 1
    total, sums = np.zeros(n), np.zeros((n, len(bias)))
    letters = None
    for values, whole, places in _grams(data, at):
        if letters is None:
            letters = sums_by_text(values, places) > 0
            continue
        sums += sums_by_text(table[values] * whole[:, None], places)
        total += sums_by_text(whole, places)
    if not len(bias):
        return np.full(n, -1), np.zeros(n)
    p = ftrl.softmax((sums / np.maximum(total, 1)[:, None] + bias) / temperature)
    return np.where(letters, p.argmax(axis=1), -1), np.where(letters, p.max(axis=1), 0.0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 800) -> LanguageModel:
    """Learns from documents with a language: some most_rows of each at most, chosen by the hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("id is not null and text is not null and lang is not null")
    table = bounded_sample(rows, "lang", most_rows).select("id", "text", "lang").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    return fit(table["text"].combine_chunks(), table["lang"].to_pylist())


def language(model: LanguageModel, text: Column) -> Column:
    """A struct of lang and score, the probability of that language. A text that is null or has no letters is `und`
    with score 0; so is every text for a model that learned from no rows. Python sees the texts alone, so other
    columns, whatever their names, stay where they are."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = model.model.table(BITS)
        names = np.array([*model.languages, UNDETERMINED], object)
        for texts in batches:
            data, at = text_bytes(texts)
            parts = [predict(table, model.model.bias, model.temperature, data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at)]
            index = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            score = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names[index], pa.string()), pa.array(score)], names=["lang", "score"])

    ship(SparkSession.active())
    return F.arrow_udf(run, "lang string, score double")(text.cast("string"))


def language_id(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_col: str = "__lang_pred", score_col: str = "__score") -> DataFrame:
    """docs with the columns lang_col and score_col: see language. Columns of docs that have these names (in any case)
    are replaced. All others are kept; rows that repeat are each judged; an empty table gives no rows."""
    found = language(model, F.col(text_col))
    return docs.withColumns({lang_col: found["lang"], score_col: found["score"]})
