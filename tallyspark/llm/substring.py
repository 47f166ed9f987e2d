"""Substring deduplication: repeated windows of words, found by Rabin-Karp hashes.

Words are the symbols (their XXH64), and every window of ``width`` words gets its polynomial
modulo the prime 2**61 - 1 at a fixed random base, the Rabin-Karp hash.  A window's anchor is
the smallest hash of the ``PHRASE``-word phrases in it, so equal windows have equal anchors, and
consecutive windows mostly share theirs.  Spark counts the anchors first: a window whose anchor
occurs in one document only occurs once, and isn't sent further.  The hashes of all other
windows are then counted by anchor and hash, and repeated windows merge into maximal intervals.

That count is the same as of all windows, for a twentieth of the shuffle.  A hash only proposes:
before any word goes, the words of every repeated interval are compared, as SHA-256 of
short pieces, with those of the document it repeats.  Anchors under which a piece differs are
judged again by the SHA-256 of whole windows instead of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import settle, small_batches

WIDTH, PHRASE = 50, 8
#: Runs of one anchor beyond which its windows are counted one a row, so that no task gets them all.
HOT_RUNS = 4_000
#: Anchors that can be hot, at most: of more runs than all runs over this there are no more.
HOT_ANCHORS = 500_000
#: Tasks among which one hot window's rows are dealt.
SALTS = 16
LAST_ID = (1 << 63) - 1

PRIME = (1 << 61) - 1
#: Fixed random base of the Rabin-Karp hash.
BASE = 0x1A2F0C5E7B9D3461
#: Intervals are compared in pieces that end at multiples of so many words of the earlier document,
#: so that its many copies ask for the same few pieces.
PIECE_WORDS = 64

SPAN = "id long, text_key long, anchor long, from int, to int, rep_id long, rep_key long, rep_from int"

_LOW32, _LOW29, _P = np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1), np.uint64(PRIME)
_3, _29, _32, _61 = (np.uint64(k) for k in (3, 29, 32, 61))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: int) -> np.ndarray:
    """``a * b`` modulo the prime, in 64-bit arithmetic."""
    high, low = a >> _32, a & _LOW32
    b_high, b_low = np.uint64(b >> 32), np.uint64(b & 0xFFFFFFFF)
    ends, middle = low * b_low, high * b_low + low * b_high
    return _reduced((ends & _P) + (ends >> _61) + ((high * b_high) << _3) + (middle >> _29) + ((middle & _LOW29) << _32))


def polynomials(symbols: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """The Rabin-Karp hash of every ``width`` symbols: of m + k of them from those of m and of k."""
    out, done, part, size = symbols, 0, symbols, 1
    while True:
        if width & size:
            n = max(0, len(symbols) - done - size + 1)
            out = _reduced(times(out[:n], pow(base, size, PRIME)) + part[done : done + n]) if done else part
            done += size
        if done == width:
            return out
        part = _reduced(times(part[:-size], pow(base, size, PRIME)) + part[size:])
        size *= 2


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Hashed:
    """A text's words as symbols, and the hashes of its windows."""

    def __init__(self, text: str | None):
        words = _words(text)
        self.n = len(words)
        self.symbols = _reduced(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n))

    def anchors(self, width: int, phrase: int) -> np.ndarray:
        """For each window, the least hash of the phrases in it."""
        low, reach, wide = polynomials(self.symbols, phrase), 1, width - phrase + 1
        while 2 * reach <= wide:
            low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
        more = wide - reach
        return np.minimum(low[: len(low) - more], low[more:])

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window."""
        return polynomials(self.symbols, width)


def _runs(width: int, phrase: int):
    """``id, text_key, text`` -> runs of windows that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, count, anchor = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                doc = Hashed(text)
                if doc.n < width:
                    continue
                low = doc.anchors(width, phrase)
                at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                first.append(at)
                count.append(np.diff(np.append(at, len(low))))
                anchor.append(low[at])
                ids.append(np.full(len(at), i))
            rows = np.concatenate(ids) if ids else np.empty(0, np.int64)
            cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(cat(anchor, np.int64)), pa.array(cat(first, np.int32)), pa.array(cat(count, np.int32))],
                ["id", "text_key", "anchor", "first", "windows"],
            )

    return run


def _window_hashes(width: int):
    """``id, text_key, text, runs`` -> each run with its windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("anchor", pa.int64()), ("hot", pa.bool_()), ("first", pa.int32()), ("hashes", pa.binary())])
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                windows = Hashed(text).windows(width)
                for r in runs:
                    out.append((doc_id, key, r["anchor"], r["hot"], r["first"], windows[r["first"] : r["first"] + r["windows"]].tobytes()))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def _repeats(width: int):
    """Runs sorted by anchor and id -> ``SPAN``: intervals of words whose windows start earlier, in
    another document, and where the first of these has them.

    What is remembered between batches is the last anchor's distinct windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None, np.empty(0, np.uint64), np.empty((0, 3), np.int64))
        kept: tuple = none
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keys, anchors, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            blobs = batch.column(5).to_pylist()
            count = np.fromiter((len(b) // 8 for b in blobs), np.int64, len(blobs))
            row = np.repeat(np.arange(len(blobs)), count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            turn = np.cumsum(np.concatenate([[0], anchors[1:] != anchors[:-1]]))
            before = kept if kept[0] == anchors[0] else none
            n = len(before[1])
            h = np.concatenate([before[1], np.frombuffer(b"".join(blobs), np.uint64)])
            group = np.concatenate([np.zeros(n, np.int64), turn[row]])
            at = np.concatenate([before[2], np.stack([ids[row], keys[row], first[row] + offset], 1)])
            order = np.lexsort((h, group))  # stable: the smallest id of a window comes first
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1])])
            rep = np.empty(len(h), np.int64)
            rep[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            last = order[new & (group[order] == turn[-1])]
            kept = (anchors[-1], h[last], at[last])
            hit = n + np.flatnonzero((at[:, 0] > at[rep, 0])[n:])
            if len(hit):
                yield _spans(row[hit - n], at[hit], anchors[row[hit - n]], at[rep[hit]], width)

    return run


def _spans(row: np.ndarray, at: np.ndarray, anchor: np.ndarray, rep: np.ndarray, width: int) -> pa.RecordBatch:
    """Windows one after another, which repeat windows one after another, as one interval."""
    step = (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & (at[1:, 2] == at[:-1, 2] + 1) & (rep[1:, :2] == rep[:-1, :2]).all(1) & (rep[1:, 2] == rep[:-1, 2] + 1)
    a = np.flatnonzero(np.concatenate([[True], ~step]))
    b = np.append(a[1:], len(row)) - 1
    columns = (at[a, 0], at[a, 1], anchor[a], at[a, 2].astype(np.int32), (at[b, 2] + width).astype(np.int32), rep[a, 0], rep[a, 1], rep[a, 2].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "text_key", "anchor", "from", "to", "rep_id", "rep_key", "rep_from"])


def _merge(width: int):
    """``id, text_key, windows`` of one text -> ``SPAN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, windows in zip(*(c.to_pylist() for c in batch.columns)):
                rows = np.array(sorted((w["from"], w["anchor"], w["rep_id"], w["rep_key"], w["rep_from"]) for w in windows), np.int64)
                own = np.stack([np.full(len(rows), doc_id), np.full(len(rows), key), rows[:, 0]], 1)
                yield _spans(np.zeros(len(rows), np.int64), own, rows[:, 1], rows[:, 2:], width)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, text_key, text, spans, asked`` -> the SHA-256 of each piece, named by the earlier document's place.

    ``spans`` are the text's own repeats, ``asked`` the pieces that others say they repeat of it.
    """
    schema = pa.schema([("rep_id", pa.int64()), ("rep_key", pa.int64()), ("at", pa.int32()), ("upto", pa.int32()), ("digest", pa.binary())])
    for batch in batches:
        out: set[tuple] = set()
        for doc_id, key, text, spans, asked in zip(*(c.to_pylist() for c in batch.columns)):
            words = _words(text)
            for s in spans or []:
                shift = s["from"] - s["rep_from"]
                for a, b in _cuts(s["rep_from"], s["rep_from"] + s["to"] - s["from"]):
                    out.add((s["rep_id"], s["rep_key"], a, b, _digest(words[a + shift : b + shift])))
            for s in asked or []:
                out.add((doc_id, key, s["at"], s["upto"], _digest(words[s["at"] : s["upto"]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _cuts(a: int, b: int) -> list[tuple[int, int]]:
    """``a`` to ``b``, cut at multiples of ``PIECE_WORDS``."""
    edges = [a, *range((a // PIECE_WORDS + 1) * PIECE_WORDS, b, PIECE_WORDS), b]
    return list(zip(edges, edges[1:]))


def pieces_of(spans: DataFrame) -> DataFrame:
    """``rep_id, rep_key, at, upto, anchor``: the same cuts, of the earlier documents."""
    end = F.col("rep_from") + F.col("to") - F.col("from")
    first = F.floor(F.col("rep_from") / PIECE_WORDS).cast("int")
    block = F.explode(F.sequence(first, F.floor((end - 1) / PIECE_WORDS).cast("int")))
    cut = spans.select("rep_id", "rep_key", "anchor", "rep_from", end.alias("end"), block.alias("block"))
    start, stop = F.col("block") * PIECE_WORDS, (F.col("block") + 1) * PIECE_WORDS
    return cut.select("rep_id", "rep_key", F.greatest("rep_from", start).alias("at"), F.least("end", stop).alias("upto"), "anchor")


def _whole_windows(width: int):
    """``id, text_key, text, runs`` -> each window's own SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("anchor", pa.int64()), ("from", pa.int32()), ("digest", pa.binary())])
        for batch in batches:
            for doc_id, key, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(text)
                out = [(doc_id, key, r["anchor"], i, _digest(words[i : i + width])) for r in runs for i in range(r["first"], r["first"] + r["windows"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text, spans`` -> counts, maximal intervals and the kept words."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            words = _words(text)
            merged: list[list[int]] = []
            for a, b in sorted((s["from"], s["to"]) for s in spans or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept += words[at:a]
                at = b
            kept += words[at:]
            joined = b" ".join(kept)
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), len(merged), joined.decode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "n_intervals", "kept"],
        )


def remove_repeats(docs: DataFrame, width: int = WIDTH, phrase: int = PHRASE, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n_words, n_removed, kept_sha256, n_intervals, kept``.

    A word goes if a window of ``width`` words that covers it also starts in a document with
    a smaller doc_id; so each repeated passage stays where its doc_id is smallest.  Windows
    are judged on the input.  ``kept`` is the remaining words joined by one space.

    Null or empty text: no words, nothing removed.  A null doc_id counts as larger than all
    others.  Rows that repeat a doc_id don't remove each other's words; each is returned.  Texts
    shorter than a window stay as they are.  A text of any length is read whole, at 16 bytes a
    word.  Other columns aren't read, whatever their names.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    last = F.lit(LAST_ID)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    runs = settle(keyed.filter("text is not null").mapInArrow(_runs(width, phrase), "id long, text_key long, anchor long, first int, windows int"), "runs")

    hot_runs = max(hot_runs, runs.count() // HOT_ANCHORS)
    shared = runs.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("runs"))
    shared = settle(shared.filter("low < high").select("anchor", (F.col("runs") > hot_runs).alias("hot")), "anchors")
    hot = F.broadcast(shared.filter("hot"))  # HOT_ANCHORS rows at most, by their least number of runs
    cold_marks = runs.join(hot, "anchor", "left_anti").join(shared.filter("not hot"), "anchor")
    marks = cold_marks.unionByName(runs.join(hot, "anchor"))
    # Sets here and below: rows that repeat a text and its id have the same runs and spans.
    of_text = marks.groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "windows", "anchor", "hot")).alias("runs"))
    hashed = settle(
        keyed.join(of_text, ["id", "text_key"]).select("id", "text_key", "text", "runs").mapInArrow(_window_hashes(width), "id long, text_key long, anchor long, hot boolean, first int, hashes binary"),
        "windows",
    )
    sorted_ = hashed.filter("not hot").repartition("anchor").sortWithinPartitions("anchor", "id")
    proposed = settle(sorted_.mapInArrow(_repeats(width), SPAN).unionByName(_hot_repeats(hashed.filter("hot"), width)), "repeats")
    spans = _confirmed(proposed, keyed, marks, width)

    by_text = spans.groupBy("id", "text_key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    marked = keyed.join(by_text, ["id", "text_key"], "left")
    doc_id = F.when(F.col("id") < last, F.col("id")).alias("doc_id")
    return marked.select(doc_id, "text", "spans").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_intervals long, kept string")


def _confirmed(proposed: DataFrame, keyed: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """``id, text_key, from, to`` of the repeats whose words are those of the earlier document.

    Each piece of an interval has one SHA-256 if all that repeat it, and the document they
    repeat, have the same words; where it has several, its anchors are judged by whole windows.
    """
    own = proposed.groupBy("id", "text_key").agg(F.collect_set(F.struct("from", "to", "rep_id", "rep_key", "rep_from")).alias("spans"))
    asked = pieces_of(proposed).select("rep_id", "rep_key", "at", "upto").distinct()
    asked = asked.groupBy(F.col("rep_id").alias("id"), F.col("rep_key").alias("text_key")).agg(F.collect_list(F.struct("at", "upto")).alias("asked"))
    read = keyed.join(own.join(asked, ["id", "text_key"], "full"), ["id", "text_key"]).select("id", "text_key", "text", "spans", "asked")
    digests = read.mapInArrow(_digests, "rep_id long, rep_key long, at int, upto int, digest binary")
    place = ["rep_id", "rep_key", "at", "upto"]
    differing = settle(digests.groupBy(*place).agg(F.count_distinct("digest").alias("n")).filter("n > 1").drop("n"), "differing")
    if differing.isEmpty():
        return proposed.select("id", "text_key", "from", "to")

    anchors = settle(pieces_of(proposed).join(differing, place).select("anchor").distinct(), "differing-anchors")
    runs = marks.join(anchors, "anchor", "left_semi").groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "windows", "anchor")).alias("runs"))
    windows = settle(keyed.join(runs, ["id", "text_key"]).select("id", "text_key", "text", "runs").mapInArrow(_whole_windows(width), "id long, text_key long, anchor long, from int, digest binary"), "whole-windows")
    least = windows.groupBy("anchor", "digest").agg(F.min("id").alias("least"))
    again = windows.join(least, ["anchor", "digest"]).filter("id > least")
    kept = proposed.join(anchors, "anchor", "left_anti").select("id", "text_key", "from", "to")
    return kept.unionByName(again.select("id", "text_key", "from", (F.col("from") + width).alias("to")))


def _hot_repeats(runs: DataFrame, width: int) -> DataFrame:
    """``SPAN`` of anchors of very many runs, one row a window: the grouping combines before it shuffles."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("hashes") / 8 - 1).cast("int")), lambda i: _slice(F.col("hashes"), i)))
    windows = runs.select("id", "text_key", "anchor", "first", at.alias("pos", "hash"), F.pmod(F.xxhash64("id", "first"), F.lit(SALTS)).alias("salt"))
    windows = windows.select("id", "text_key", "anchor", (F.col("first") + F.col("pos")).alias("from"), "hash", "salt")
    least = windows.groupBy("anchor", "hash").agg(F.min(F.struct("id", "text_key", "from")).alias("rep"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    hits = windows.join(least, ["anchor", "hash", "salt"]).filter(F.col("id") > F.col("rep.id"))
    window = F.struct("from", "anchor", F.col("rep.id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), F.col("rep.from").alias("rep_from"))
    return hits.groupBy("id", "text_key").agg(F.collect_set(window).alias("windows")).mapInArrow(_merge(width), SPAN)


def _slice(blob: Column, i: Column) -> Column:
    return F.substring(blob, (i * 8 + 1).cast("int"), F.lit(8))
