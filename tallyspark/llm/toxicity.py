"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

A window is a word between spaces with a fixed ending, so that the compressor can match
up to the word's end.  Its distance is how many bytes shorter it becomes with the toxic
dictionary.  Both dictionaries end in the same ordinary text: ordinary words are found
at the same place in either and cost the same.  The toxic one is trained on what toxic
documents have in excess: strings whose share of toxic documents is a multiple of their
share of ordinary ones.  A document's score is calibrated from how many of its windows
pass each of a row of distance thresholds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import is_held_out, settle, small_batches
from tallyspark.llm.labels import draw, training_labels

#: Labelled documents the model is fitted on, at most, and bytes of their texts for each class: documents
#: are drawn while both last, and of each the whole text counts.  A text over a
#: ``LARGEST``-th of the bytes would leave no room for others; it is scored and not learned from.
TOXIC_ROWS, ORDINARY_ROWS, FIT_BYTES, LARGEST = 2_000, 5_000, 64 << 20, 64
#: Bytes of the ordinary and the toxic dictionary's own part.
ORDINARY_BYTES, TOXIC_BYTES = 8_192, 2_048
LEVEL, ENDING = 9, 24
#: Lengths of the strings compared, least excess, least share of toxic documents and least number.
STRINGS, EXCESS, LEAST_SHARE, LEAST_DOCS = (4, 5, 6, 7, 8, 10, 12), 8.0, 0.012, 3
#: Distances from which windows are counted.
THRESHOLDS = (1, 2, 3, 4, 5)
PREDICT_AT = 0.3
#: Bytes of a window, and windows whose distance a worker remembers.
LONGEST, REMEMBER = 96, 400_000


def _strings(text: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text as padded words, and the n-byte strings inside them: positions and hashes."""
    joined = np.frombuffer(b" " + b"  ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" ", np.uint8)
    if len(joined) < n:
        return joined, np.empty(0, np.int64), np.empty(0, np.uint64)
    hashed = np.zeros(len(joined) - n + 1, np.uint64)
    space = np.zeros(len(hashed), np.int64)
    for k in range(n):
        part = joined[k : k + len(hashed)]
        hashed = (hashed ^ part) * np.uint64(0x100000001B3)
        hashed ^= hashed >> np.uint64(29)
        if 0 < k < n - 1:
            space += part == 32
    at = np.flatnonzero(space == 0)
    return joined, at, hashed[at]


def _document_shares(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-byte string's hash and in how many texts it occurs."""
    found = [np.unique(_strings(t, n)[2]) for t in texts]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _one_of_each_kind(texts: list[str]) -> list[str]:
    """Texts without near copies: those that share their least 5-word phrase count once."""
    kept: dict[int, str] = {}
    for t in texts:
        words = t.lower().split()
        kept.setdefault(min((zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))), default=0), t)
    return list(kept.values())


def toxic_strings(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """For each toxic text, those parts of its words that toxic texts have in excess."""
    own, other = _one_of_each_kind(toxic), _one_of_each_kind(ordinary)
    mark = {}
    for n in STRINGS:
        hashes, docs = _document_shares(own, n)
        elsewhere, count = _document_shares(other, n)
        at = np.minimum(np.searchsorted(elsewhere, hashes), max(len(elsewhere) - 1, 0))
        plain = np.where(elsewhere[at] == hashes, count[at], 0) if len(elsewhere) else np.zeros(len(hashes))
        enough = docs >= max(LEAST_DOCS, LEAST_SHARE * len(own))
        mark[n] = hashes[enough & (docs / max(len(own), 1) > EXCESS * (plain + 1) / max(len(other), 1))]
    out = []
    for t in toxic:
        covered = None
        for n in STRINGS:
            joined, at, hashes = _strings(t, n)
            if covered is None:
                covered = np.zeros(len(joined) + max(STRINGS), bool)
            hit = at[np.isin(hashes, mark[n])]
            for k in range(n):
                covered[hit + k] = True
        if covered is not None and covered.any():
            out.append(joined[covered[: len(joined)]].tobytes())
    return out


def _train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


class Distance(dict):
    """Window -> bytes saved by the toxic dictionary; forgets when it has grown too large."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.ending = ordinary[-ENDING:]
        self.toxic, self.ordinary = self._compressor(toxic + ordinary), self._compressor(ordinary)

    @staticmethod
    def _compressor(content: bytes):
        if len(content) < 8:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        window = b" " + word + b" " + self.ending
        value = self[word] = len(self.ordinary(window)) - len(self.toxic(window))
        return value

    def features(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "surrogatepass").split()
        if any(len(w) > LONGEST for w in words):
            words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
        saved = np.fromiter(map(self.__getitem__, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        passed = [int((saved >= t).sum()) for t in THRESHOLDS]
        top = np.sort(np.partition(saved, -3)[-3:] if len(saved) > 3 else saved)
        return np.array([top[-1], top.mean(), saved.mean(), *np.log1p(passed), *(np.array(passed) / len(saved)), np.log1p(len(words))], float)


class Model:
    """Both dictionaries, and the logistic calibration of a text's distances."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.constant = None if toxic and ordinary else float(bool(toxic))
        if self.constant is not None:
            return
        phrases = [w.encode("utf-8", "surrogatepass") for t in ordinary for w in re.findall(r"\S+(?:\s+\S+){0,7}", t.lower())]
        self.ordinary = _train_dictionary(phrases, ORDINARY_BYTES)
        self.toxic = _train_dictionary(toxic_strings(toxic, ordinary), TOXIC_BYTES)

    def features(self):
        """The features of a batch of texts, a row each."""
        distance = Distance(self.toxic, self.ordinary)
        return lambda texts: np.array([distance.features(t) for t in texts]).reshape(len(texts), -1)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        self.weights = np.zeros(z.shape[1])
        weight = weight / weight.mean()
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(z.shape[1])
            self.weights += np.linalg.solve(h, z.T @ (weight * (y - p)) - 0.1 * self.weights)

    def scorer(self):
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        features = self.features()

        def score(texts: list[str | None]) -> np.ndarray:
            x = (features(texts) - self.mean) / self.scale
            return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

        return score


def drawn_texts(docs: DataFrame, known: DataFrame, most: int, fit_bytes: int) -> DataFrame:
    """``doc_id, y, text`` of at most ``most`` labelled documents that hold ``fit_bytes`` together."""
    ids = F.broadcast(draw(known, most))  # at most ``most`` rows
    size = F.octet_length("text").cast("long")
    fitting = docs.filter("text is not null").filter(size <= fit_bytes // LARGEST).join(ids, "doc_id")
    rows = settle(fitting.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled-texts")
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = rows.select("doc_id", F.sum(size).over(order).alias("upto")).filter(F.col("upto") <= fit_bytes).select("doc_id")
    return rows.join(F.broadcast(fits), "doc_id")


def _featured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.features()
        for batch in batches:
            x = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Fit on at most ``toxic_rows`` and ``ordinary_rows`` labelled documents of the training fold,
    and ``fit_bytes`` of text of either class; of rows that repeat an id the least text counts.
    Classes weigh as they occur in the labels.  The dictionaries are trained on the driver
    from those texts, all their phrases; the distances they are calibrated by come from Spark tasks."""
    known = training_labels(labels, "toxic").withColumn("y", (F.col("y") > 0).cast("int"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = [drawn_texts(docs, known.filter(F.col("y") == y), most, fit_bytes) for y, most in ((1, toxic_rows), (0, ordinary_rows))]
    model = Model(*([r["text"] for r in sorted(rows.collect(), key=lambda r: r["doc_id"])] for rows in drawn))
    if model.constant is None:
        spread = docs.sparkSession.sparkContext.defaultParallelism
        x, y, weight = [], [], []
        for value, rows in zip((1, 0), drawn):
            found = sorted(rows.select("doc_id", "text").repartition(spread).mapInArrow(_featured(model), "doc_id long, x array<double>").collect())
            x += [r["x"] for r in found]
            y += [value] * len(found)
            weight += [counts[value] / len(found)] * len(found)
        model.calibrate(np.array(x), np.array(y, float), np.array(weight))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text`` and ``doc_id, toxic`` -> ``doc_id, held_out, score, predicted``.

    Null and empty texts are scored as texts without windows; a text of any length is scored
    whole.  With no training label of one class every score is the other class; of labels that
    contradict each other toxic holds.  Repeated rows get a row each; rows without an id are
    scored and not learned from.  Only the named columns are read.  An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
