"""A quality classifier from positive and unlabelled text (non-negative unbiased risk).

Trusted positives are documents labelled good; every document of the training fold is
unlabelled, whatever its label.  All of both count in the risk: each belongs to the nearest of
a bounded number of drawn documents, and Spark sums the rows and features of these cells.
The share of good documents is estimated first, from how the trusted ones stand out among the
unlabelled.  Then small networks minimise the non-negative risk.  Which documents are labelled
bad is never used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import is_held_out, settle, small_batches
from tallyspark.llm.labels import draw, training_labels

#: Cells that the training fold is summed in, at most.
CELLS = 4_000
#: Sums are kept in these parts of one, so that their order doesn't matter.
UNIT = 1e-6
SYMBOLS = "!?.,;:'\"-_*#$%&|<>{}[]()=+/\\@~^"
PREDICT_AT = 0.7
HIDDEN, STEPS, RATE, DECAY = 24, 500, 0.02, 1e-4
#: One network each; their scores are averaged.
SEEDS = (5, 8, 13)


def text_features(text: str | None) -> np.ndarray:
    """What a text looks like: shares of symbols, capitals and digits, repetition, word shapes."""
    text = text or ""
    words, size = text.split(), max(len(text), 1)
    n = max(len(words), 1)
    lines = [line for line in text.split("\n") if line]
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    raw = text.encode("utf-8", "surrogatepass")
    alpha = sum(map(str.isalpha, words))
    return np.array(
        [
            *(np.sqrt(text.count(c) / size) for c in SYMBOLS),
            np.log1p(len(words)),
            len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n,
            sum(map(str.isupper, words)) / n,
            sum(map(str.istitle, words)) / n,
            alpha / n,
            sum(map(str.isdigit, words)) / n,
            lengths.mean() / 10,
            lengths.std() / 10,
            np.log1p(lengths.max()),
            np.log1p(len(lines)),
            1 - len(set(lines)) / max(len(lines), 1),
            np.log1p(size / max(len(lines), 1)),
            len(zlib.compress(raw, 1)) / (len(raw) + 20),
            (len(raw) - len(text)) / size,
            float(not words),
        ]
    )


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, x`` (array of float)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t).astype(np.float32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<float>")


class Network:
    """One hidden layer; ``value`` above 0 means good."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0

    def shaped(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def value(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3], h

    def step(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> None:
        """One Adam step, given the risk's slope at each row's value."""
        back = slope[:, None] * self.p[2] * (1 - h * h)
        grads = [z.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]
        self.t += 1
        for k, g in enumerate(grads):
            g = g + DECAY * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.value(self.shaped(x))[0])


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def estimate_prior(value: np.ndarray, trusted: np.ndarray, rows: np.ndarray) -> float:
    """The share of positives among ``rows``, from values at which ``trusted`` and ``rows`` documents stand.

    Positives are a part of the unlabelled, so for any threshold of the value the unlabelled pass
    it at least ``share`` times as often as the positives.  The least such ratio over thresholds,
    with a margin for chance where few rows pass, is the estimate.
    """
    order = np.argsort(-value, kind="stable")
    p, u = np.cumsum(trusted[order]) / trusted.sum(), np.cumsum(rows[order]) / rows.sum()
    margin = np.sqrt(np.log(40) / 2) * (trusted.sum() ** -0.5 + rows.sum() ** -0.5)
    enough = p >= 0.05
    ratio = np.where(enough, (u + margin) / np.maximum(p, 1e-9), np.inf)
    best = int(np.argmin(ratio))
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def risk(value: np.ndarray, trusted: np.ndarray, rows: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk  pi R+(P) + max(0, R-(U) - pi R-(P))  of values at which ``trusted`` and
    ``rows`` documents stand, with the logistic loss; and the slope to follow.  Where the second
    part is below zero, the step leads back."""
    p, u = trusted / trusted.sum(), rows / rows.sum()
    as_positive, as_negative = (p * np.logaddexp(0, -value)).sum(), ((u - prior * p) * np.logaddexp(0, value)).sum()
    good = sigmoid(value)
    slope = prior * p * (good - 1) + (u - prior * p) * good if as_negative >= 0 else -(u - prior * p) * good
    return float(prior * as_positive + max(0.0, as_negative)), slope


def class_prior(x: np.ndarray, trusted: np.ndarray, rows: np.ndarray) -> float:
    """:func:`estimate_prior` on the values of an ordinary classifier of the two; each half of
    the cells is judged by what the other half taught, so that nothing is learned by heart."""
    value, half = np.zeros(len(x)), np.random.default_rng(7).permutation(len(x)) % 2
    for part in (0, 1):
        own = half == part
        if not trusted[own].sum() or not rows[own].sum() or own.all():
            continue
        sorter = Network(x, seed=6)
        z, p, u = sorter.shaped(x[own]), trusted[own] / trusted[own].sum() / 2, rows[own] / rows[own].sum() / 2
        for _ in range(150):
            v, h = sorter.value(z)
            sorter.step(z, h, p * (sigmoid(v) - 1) + u * sigmoid(v))
        value[~own] = sorter.value(sorter.shaped(x[~own]))[0]
    return estimate_prior(value, trusted, rows)


def fit(x: np.ndarray, trusted: np.ndarray, rows: np.ndarray, prior: float, seed: int = 5) -> Network:
    """Minimise the non-negative risk; at ``x[k]`` stand ``trusted[k]`` and ``rows[k]`` documents."""
    net = Network(x, seed)
    z = net.shaped(x)
    for _ in range(STEPS):
        v, h = net.value(z)
        net.step(z, h, risk(v, trusted, rows, prior)[1])
    return net


def cells_of(fold: DataFrame, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x, trusted`` -> of the rows nearest to each of ``drawn`` the mean features, the trusted and all.

    Every row counts; a partition hands on one row a cell.
    """
    mean, scale = drawn.mean(0), drawn.std(0) + 1e-3
    centres = ((drawn - mean) / scale).astype(np.float32)
    half = (centres * centres).sum(1) / 2
    dim = drawn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, trusted, sums = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), np.zeros((len(centres), dim), np.int64)
        for batch in batches:
            x = np.array(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, dim)
            for at in range(0, len(x), 2_000):
                part = x[at : at + 2_000]
                cell = np.argmax(((part - mean) / scale).astype(np.float32) @ centres.T - half, axis=1)
                np.add.at(rows, cell, 1)
                np.add.at(trusted, cell, batch.column(1).to_numpy(zero_copy_only=False)[at : at + 2_000].astype(np.int64))
                np.add.at(sums, cell, np.rint(part / UNIT).astype(np.int64))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(trusted[some]), pa.array(rows[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cell", "trusted", "rows", "sums"]
        )

    parts = fold.select("x", "trusted").mapInArrow(run, "cell int, trusted long, rows long, sums array<long>")
    totals = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dim)]
    found = parts.groupBy("cell").agg(F.sum("trusted").alias("trusted"), F.sum("rows").alias("rows"), *totals).orderBy("cell").collect()
    trusted, rows = (np.array([r[c] for r in found], np.float64) for c in ("trusted", "rows"))
    return np.array([[r[f"s{k}"] for k in range(dim)] for r in found], np.float64) * UNIT / rows[:, None], trusted, rows


def score_quality(docs: DataFrame, labels: DataFrame, cells: int = CELLS) -> DataFrame:
    """``doc_id, text`` and ``doc_id, quality`` -> ``doc_id, held_out, score, predicted``.

    Fitted on all documents of the training fold, trusted or not, summed in at most ``cells``
    cells; every document's whole text, however long, is scored, null and empty ones too.
    Without a trusted positive every score is 0.  Repeated rows get a row each; rows without an
    id are scored and not learned from.  Only the named columns are read.  An empty table gives
    an empty result.
    """
    seen = settle(features(docs), "quality-features")
    fold = seen.filter(~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    good = training_labels(labels, "quality").filter("y > 0").select("doc_id", F.lit(True).alias("good"))
    marked = fold.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("good", F.lit(False)))
    drawn, nets = np.array([r["x"] for r in draw(fold, cells).collect()], np.float64), []
    if len(drawn):
        x, trusted, rows = cells_of(marked, drawn)
        if trusted.sum():
            prior = class_prior(x, trusted, rows)
            nets = [fit(x, trusted, rows, prior, seed) for seed in SEEDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score = np.zeros(n)
            if nets and n:
                x = np.array(batch.column(1).flatten(), np.float64).reshape(n, -1)
                score = np.mean([net.score(x) for net in nets], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = seen.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
