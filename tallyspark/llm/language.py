"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent 1- to 3-grams.  A document is
compared by the out-of-place distance: for each of its own most frequent n-grams, how
far its rank is from the rank in the profile; an n-gram that the profile lacks costs
the profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.llm.common import is_held_out, small_batches

#: N-grams of a profile, of a language and of a document alike.
PROFILE_SIZE = 300
#: N-grams that a task gathers before it counts them.
CHUNK = 1_000_000
UNKNOWN = "und"
GAP = 0x5F

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point, whether it is a letter; made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngrams(text: str | None) -> np.ndarray:
    """Codes of the 1- to 3-grams of a text's words, lower-cased; three 21-bit letters a code.

    Words are runs of letters and are padded with one gap on either side.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _letter_table()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    padded = np.full(len(points) + 2, GAP, np.int64)
    padded[1:-1] = np.where(letter, points, GAP)
    padded = padded[np.r_[True, (padded[1:] != GAP) | (padded[:-1] != GAP)]]
    inner = padded != GAP
    one, two = padded[inner], (padded[:-1] << 21) | padded[1:]
    three = ((padded[:-2] << 42) | (padded[1:-1] << 21) | padded[2:])[inner[1:-1]]
    return np.concatenate([one, two, three])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, text`` -> ``lang, gram, n``: one row for each n-gram of a language in this task."""
    open_: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    done: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def close(lang: str) -> None:
        if open_.get(lang):
            done.setdefault(lang, []).append(np.unique(np.concatenate(open_[lang]), return_counts=True))
            open_[lang], size[lang] = [], 0

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = ngrams(text)
            open_.setdefault(lang, []).append(found)
            size[lang] = size.get(lang, 0) + len(found)
            if size[lang] > CHUNK:
                close(lang)
    for lang in list(open_):
        close(lang)
        if lang in done:
            grams, where = np.unique(np.concatenate([g for g, _ in done[lang]]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([n for _, n in done[lang]])).astype(np.int64)
            for at in range(0, len(grams), 50_000):
                part = grams[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(counts[at : at + 50_000])], ["lang", "gram", "n"])


def train_profiles(labelled: DataFrame, profile_size: int = PROFILE_SIZE) -> DataFrame:
    """``lang, text`` -> ``lang, gram, place``: each language's most frequent n-grams, from all rows.

    Rows of null language or text teach nothing.  Ties in frequency go to the smaller code.
    """
    counted = labelled.select("lang", "text").filter("lang is not null and text is not null").mapInArrow(_count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return summed.withColumn("place", place).filter(F.col("place") <= profile_size).select("lang", "gram", (F.col("place") - 1).alias("place"))


class Profiles:
    """The profiles of all languages as one table: n-gram -> place in each language."""

    def __init__(self, rows: list, profile_size: int = PROFILE_SIZE):
        self.size = profile_size
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        number = {lang: i for i, lang in enumerate(self.langs)}
        for r in rows:
            self.places[np.searchsorted(self.grams, r["gram"]), number[r["lang"]]] = r["place"]

    def judge(self, text: str | None) -> tuple[str, float]:
        found = ngrams(text)
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0
        grams, counts = np.unique(found, return_counts=True)
        own = grams[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = len(self.grams) - 1
        places = self.places[np.where(self.grams[at] == own, at, len(self.grams))]
        apart = np.where(places < 0, self.size, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        near = 1.0 - apart / (self.size * len(own))
        best = int(np.argmin(apart))
        return self.langs[best], float(near[best] / near.sum()) if near.sum() > 0 else 0.0


def predict_language(docs: DataFrame, profiles: DataFrame, profile_size: int = PROFILE_SIZE, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, lang_pred, score`` with the nearest profile's language.

    Columns named in ``carry`` are handed through, after the others.

    ``score`` is the nearest profile's closeness as a share of all profiles' closeness.
    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Distances that tie go to the language that sorts first.  Repeated rows each get a row.
    The profiles are languages times ``profile_size`` rows, so they travel with the tasks.
    """
    small_batches(docs.sparkSession)
    model = Profiles(profiles.collect(), profile_size)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.judge(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([lang for lang, _ in said], pa.string()), pa.array([score for _, score in said], pa.float64()), *batch.columns[2:]],
                ["doc_id", "lang_pred", "score", *carry],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", *carry)
    schema = StructType().add("doc_id", "long").add("lang_pred", "string").add("score", "double")
    for field in docs.select(*carry).schema if carry else ():
        schema.add(field)
    return rows.mapInArrow(judge, schema)


def identify(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the training fold of ``docs`` (null languages aside), predict all of it.

    ``doc_id, text, lang`` -> ``doc_id, held_out, lang_pred, score``, then the columns of ``carry``.
    A null doc_id counts as the empty string for the fold and stays null; rows that repeat are
    learned from and judged each for itself; texts of any length are read whole; ties, null
    and letterless texts as in :func:`predict_language`.  Columns that aren't named aren't read.  An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    profiles = train_profiles(docs.filter(~is_held_out(F.col("doc_id"))))
    said = predict_language(docs, profiles, carry=carry)
    return said.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *carry)
