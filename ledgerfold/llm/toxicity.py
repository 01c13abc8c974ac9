"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (of letters in lower case; all else is a space) that it holds. The
log-count ratio of an n-gram compares how many toxic and how many other training texts hold it. The n-grams with
the most significant ratios become features, each scaled by its ratio, and a logistic regression weighs them.
The fitted model is some thousand numbers; executors score whole texts with it, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, ship
from .textarrays import code_points, gram_slots, slices, text_bytes

ORDERS, BITS = (3, 4, 5, 6), 20
_fold: list[np.ndarray] = []


def folded(points: np.ndarray) -> np.ndarray:
    """Letters in lower case, everything else a space."""
    if not _fold:
        table = np.full(0x110000, 0x20, np.uint32)
        letters = [i for i in range(0x110000) if chr(i).isalpha()]
        table[letters] = [ord(low) if len(low := chr(i).lower()) == 1 else i for i in letters]
        _fold.append(table)
    return _fold[0][points]


def held_grams(data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (text, n-gram's slot), in order; with wanted (by slot), only of those slots."""
    points, places = code_points(data, at)
    points = folded(points)
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(places))
    pairs = []
    for n in ORDERS:
        slots, whole = gram_slots(points, places, n, BITS)
        own = np.flatnonzero(whole if wanted is None else whole & wanted[slots])
        pairs.append(text_of[own] << BITS | slots[own])
    both = np.unique(np.concatenate(pairs))
    return both >> BITS, both & (1 << BITS) - 1


@dataclass(frozen=True)
class ToxicityModel:
    slots: np.ndarray  # sorted slots of the features
    weights: np.ndarray  # ratio * weight of each
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text."""
        table = np.zeros(1 << BITS)
        table[self.slots] = self.weights
        return _probability(table, table != 0, self.bias, data, at)


def _probability(table: np.ndarray, wanted: np.ndarray, bias: float, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    text, slot = held_grams(data, at, wanted)
    margin = bias + np.bincount(text, table[slot], len(at) - 1)
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression with weighted rows, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = (weight / weight.sum()).astype(x.dtype)
    v = np.random.default_rng(0).normal(size=x.shape[1]).astype(x.dtype)
    for _ in range(20):  # the largest curvature, for the step
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v))
        v /= norm or 1
    rate = 1 / (norm / 4 + penalty + 1e-12)
    ridge = np.full(x.shape[1], penalty, x.dtype)
    ridge[-1] = 0
    w = at = np.zeros(x.shape[1], x.dtype)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        new = at - rate * (x.T @ (weight * (p - y)) + ridge * at)
        w, at = new, new + k / (k + 3) * (new - w)
    return w[:-1].astype(float), float(w[-1])


def fit(texts: pa.Array, toxic: np.ndarray, *, features: int = 2048, alpha: float = 1.0, penalty: float = 1e-4) -> ToxicityModel:
    """The model of labelled texts. With one class only (or none), the score is that class' smoothed share."""
    toxic = np.asarray(toxic, bool)
    data, at = text_bytes(texts)
    n = np.array([(~toxic).sum(), toxic.sum()])
    if not n.all():
        share = (n[1] + 0.5) / (n.sum() + 1) if n.sum() else 0.0
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))) if share else -20.0)
    held = np.zeros((2, 1 << BITS), np.int64)
    for i, j in slices(at):
        text, slot = held_grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
        held += np.bincount(slot + (toxic[i:j][text].astype(np.int64) << BITS), minlength=2 << BITS).reshape(2, -1)
    rate = (held + alpha) / (n[:, None] + 2 * alpha)
    ratio = np.log(rate[1] / rate[0])
    spread = np.sqrt((1 / (held + alpha) - 1 / (n[:, None] + 2 * alpha)).sum(axis=0))
    sure = np.where(held.sum(axis=0) >= 2, np.abs(ratio) / spread, 0)
    slots = np.sort(np.argsort(-sure, kind="stable")[:features])
    slots = slots[sure[slots] > 2]
    column = np.full(1 << BITS, -1)
    column[slots] = np.arange(len(slots))
    x = np.zeros((len(toxic), len(slots)), np.float32)
    for i, j in slices(at):
        text, slot = held_grams(data[at[i] : at[j]], at[i : j + 1] - at[i], column >= 0)
        x[i + text, column[slot]] = ratio[slots][column[slot]]
    # Both classes weigh the same in the fit of the weights; the bias is then that of balanced classes.
    w, bias = logistic(x, toxic.astype(np.float32), np.where(toxic, 0.5 / n[1], 0.5 / n[0]), penalty)
    return ToxicityModel(slots, w * ratio[slots], bias)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_rows: int = 3000) -> ToxicityModel:
    """Fits on labelled rows: most_rows of each class at most, in expectation, chosen by the hash of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(bounded_sample(known, "label", most_rows))  # some 2 * most_rows ids
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = texts.join(chosen, "id").select("id", "text", "label").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    return fit(table["text"].combine_chunks(), table["label"].to_numpy())


def score(model: ToxicityModel, text: Column) -> Column:
    """The probability that the text is toxic; a null text counts as the empty one, whose score is that of no
    features. Python sees the texts alone, so other columns, whatever their names, stay where they are."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << BITS)
        table[model.slots] = model.weights
        wanted = table != 0
        for texts in batches:
            data, at = text_bytes(texts)
            parts = [_probability(table, wanted, model.bias, data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    ship(SparkSession.active())
    return F.arrow_udf(run, "double")(text.cast("string"))


def toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "__score") -> DataFrame:
    """docs with the column score_col: see score. A column of docs that has that name (in any case) is replaced. All
    other columns are kept, nulls and repeated rows as well; an empty table gives no rows."""
    return docs.withColumn(score_col, score(model, F.col(text_col)))
