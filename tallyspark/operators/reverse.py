"""For each costing line the claims most like it, for all lines at once.

The claims' descriptions are posted by bigram in blocks, built once and written.  A line adds up
the postings of its own bigrams, which gives both directions of the likeness with every description
of a block; only descriptions that share all words without a digit can lose by differing
numbers, and of these only as many are looked at as can still be among the best.

Lines that differ in a leading code only share nearly all bigrams.  They are searched together: what they share is
added up once and bounds what each can reach, and only the descriptions that can be among the best of one of them are
compared with all.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.similarity import SIBLING_MOST, SIBLING_STEP
from tallyspark.sources.shared import settle

#: Descriptions of a block, and lines that meet it in one task, at most.
BLOCK, LINES = 50_000, 100_000
#: Lines behind one leading code that stay together, about; likenesses that are held at a time.
TOGETHER, CELLS = 2_000, 2_000_000
#: A word with a digit in front of others.
LEADING_CODE = r"^\S*[0-9]\S* "

ARRAYS = {"first_id": np.int64, "length": np.int32, "gram_from": np.int64, "posting": np.int32, "times": np.int16}
STORE = "block int, texts string, ids array<array<bigint>>, " + ", ".join(f"{name} binary" for name in ARRAYS)
FOUND = "line string, sims array<int>, ids array<bigint>"


def grams_of(packed: str) -> np.ndarray:
    letters = np.frombuffer(packed.encode("ascii", "replace"), np.uint8).astype(np.int64)
    return letters[:-1] * 256 + letters[1:]


def digit_words(text: str) -> tuple[str, Counter]:
    """The words without a digit, in order of the alphabet, and those with one."""
    words = text.split()
    plain = sorted(w for w in words if not any("0" <= c <= "9" for c in w))
    return " ".join(plain), Counter(w for w in words if any("0" <= c <= "9" for c in w))


def build(descriptions: pd.DataFrame) -> pd.DataFrame:
    """``block, a_cleaned, ids`` of one block -> its row of the store."""
    texts = descriptions["a_cleaned"].tolist()
    ids = [list(map(int, x)) for x in descriptions["ids"]]
    packed = [t.replace(" ", "") for t in texts]
    grams = [grams_of(p) for p in packed]
    of = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    pair, times = np.unique((np.concatenate(grams) if grams else np.empty(0, np.int64)) * len(texts) + of, return_counts=True)
    arrays = {
        "first_id": [x[0] for x in ids],
        "length": [len(p) for p in packed],
        "gram_from": np.searchsorted(pair // len(texts), np.arange((1 << 16) + 1)),
        "posting": pair % len(texts),
        "times": np.minimum(times, np.iinfo(np.int16).max),
    }
    stored = {name: [np.asarray(arrays[name]).astype(kind).tobytes()] for name, kind in ARRAYS.items()}
    return pd.DataFrame({"block": descriptions["block"].iloc[:1].to_numpy(), "texts": ["\n".join(texts)], "ids": [ids], **stored})


class Posted:
    """A row of the store."""

    def __init__(self, stored: pd.Series):
        self.texts, self.ids = stored["texts"].split("\n"), stored["ids"]
        for name, kind in ARRAYS.items():
            setattr(self, name, np.frombuffer(stored[name], kind))
        n = len(self.texts)
        self.forward, self.backward = np.zeros(n, np.int64), np.zeros(n, np.int64)
        words = [digit_words(t) for t in self.texts]
        self.numbers = [w for _, w in words]
        self.family: dict[str, list[int]] = {}
        for i, (plain, _) in enumerate(words):
            self.family.setdefault(plain, []).append(i)
        self.packed = {t.replace(" ", "") for t in self.texts}
        # The ids of each description as places among all of the block, which sort as they do.
        of = np.repeat(np.arange(n), [len(x) for x in self.ids])
        every = np.concatenate([np.asarray(x, np.int64) for x in self.ids])
        self.every_id, place = np.unique(every, return_inverse=True)
        self.first = np.searchsorted(of, np.arange(n + 1))
        self.place = place

    def _add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """The postings of a text's distinct bigrams to both directions."""
        for gram, n in zip(grams.tolist(), counts.tolist()):
            at = self.posting[self.gram_from[gram] : self.gram_from[gram + 1]]
            self.forward[at] += n
            self.backward[at] += self.times[self.gram_from[gram] : self.gram_from[gram + 1]]

    def best_of_codes(self, codes: list[str], rest: str, most: int) -> tuple[np.ndarray, np.ndarray]:
        """``sims, ids`` (a row a line, -1 where there are no more) of :meth:`best` for the lines ``code rest``.

        No line is a description of the block but for blanks.
        """
        tail = rest.replace(" ", "")
        base, counts = np.unique(grams_of(tail), return_counts=True)
        self.forward.fill(0)
        self.backward.fill(0)
        self._add(base, counts)
        own = [grams_of(c + tail[0]) for c in codes]
        size = np.array([len(c) for c in codes]) + len(tail)
        extra, column = np.unique(np.concatenate(own), return_inverse=True)
        held = np.zeros((len(codes), len(extra)), np.float32)
        np.add.at(held, (np.repeat(np.arange(len(codes)), [len(g) for g in own]), column), 1)
        new = ~np.isin(extra, base)
        # What the codes can add to either direction, at most.
        more_forward, more_backward = np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.int64)
        for gram, n, is_new in zip(extra.tolist(), held.max(0).astype(int).tolist(), new.tolist()):
            at = self.posting[self.gram_from[gram] : self.gram_from[gram + 1]]
            more_forward[at] += n
            if is_new:
                more_backward[at] += self.times[self.gram_from[gram] : self.gram_from[gram + 1]]
        longest = int(max(len(g) for g in own))
        least = self._likeness(np.maximum(self.forward, self.backward), int(size.max()))
        most_ = self._likeness(np.maximum(self.forward + np.minimum(more_forward, longest), self.backward + more_backward), int(size.min()))
        plain, numbers = digit_words(rest)
        members = np.array(self.family.get(plain, []), np.int64)
        asked = set(codes)
        apart = np.array([sum(abs(numbers[w] - self.numbers[i][w]) for w in numbers.keys() | self.numbers[i].keys()) for i in members.tolist()], np.int64) + 1
        # Descriptions that hold a line's code as well.
        having = [(k, w) for k, i in enumerate(members.tolist()) for w, n in self.numbers[i].items() if w in asked and n > numbers[w]]
        loss = lambda a: 2 * np.minimum(SIBLING_MOST, SIBLING_STEP * a)
        nearest = apart.copy()
        nearest[[k for k, _ in having]] -= 2
        least[members] = np.maximum(0, least[members] - loss(apart))
        most_[members] = np.maximum(0, most_[members] - loss(nearest))
        top = np.argpartition(least, -most)[-most:] if len(least) > most else np.arange(len(least))
        top = top[np.argsort(-least[top])]
        full = np.cumsum(self.first[top + 1] - self.first[top]) >= most
        near = np.flatnonzero(most_ >= least[top[np.argmax(full)]]) if full.any() else np.arange(len(self.texts))
        near = near[np.argsort(self.first_id[near], kind="stable")]
        at_near = np.full(len(self.texts), -1)
        at_near[near] = np.arange(len(near))
        times = np.zeros((len(extra), len(near)), np.float32)
        for row, gram in zip(times, extra.tolist()):
            at = at_near[self.posting[self.gram_from[gram] : self.gram_from[gram + 1]]]
            row[at[at >= 0]] = self.times[self.gram_from[gram] : self.gram_from[gram + 1]][at >= 0]
        has, times = (times > 0).astype(np.float32), times[new]
        # Of a line's bigrams those that it shares with the rest are counted backward already.
        once = (held[:, new] > 0).astype(np.float32)
        in_near = at_near[members]
        kept = in_near >= 0
        cost, forward, backward = loss(apart[kept]), self.forward[near], self.backward[near]
        lines_of: dict[str, list[int]] = {}
        for i, c in enumerate(codes):
            lines_of.setdefault(c, []).append(i)
        back = [(i, at_near[members[k]], loss(apart[k]), loss(apart[k] - 2)) for k, w in having if at_near[members[k]] >= 0 for i in lines_of[w]]
        sims, ids = np.full((len(codes), most), -1, np.int32), np.full((len(codes), most), -1, np.int64)
        step = max(1, CELLS // max(len(near), 1))
        for a in range(0, len(codes), step):
            z = slice(a, min(a + step, len(codes)))
            shared = np.maximum(forward + held[z] @ has, backward + once[z] @ times).astype(np.float64)
            raw = self._likeness(shared, size[z, None], near)
            sim = raw.copy()
            sim[:, in_near[kept]] = np.maximum(0, raw[:, in_near[kept]] - cost)
            for i, j, _, less in back:
                if z.start <= i < z.stop:
                    sim[i - a, j] = max(0, raw[i - a, j] - less)
            sims[z], ids[z] = self._first(sim, near, most)
        return sims, ids

    def _likeness(self, shared: np.ndarray, size, of=slice(None)) -> np.ndarray:
        length = self.length[of].astype(np.int64)
        sim = np.floor(2 * shared / np.maximum(size - 1 + length - 1, 1) * 100 + 0.5).astype(np.int64)
        sim[..., length < 2] = 0
        return sim

    def _first(self, sim: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` best ids of each row of likenesses with ``near``, which are in the order of their first ids."""
        n = len(near)
        key = sim * n + np.arange(n - 1, -1, -1)
        top = np.argpartition(key, -most, axis=1)[:, -most:] if n > most else np.broadcast_to(np.arange(n), sim.shape)
        texts = near[top]
        nth = self.first[texts][..., None] + np.arange(most)
        there = nth < self.first[texts + 1][..., None]
        place = self.place[np.where(there, nth, 0)]
        low = np.iinfo(np.int64).max
        order = np.where(there, ((1 << 20) - np.take_along_axis(sim, top, 1))[..., None] * (1 << 40) + place, low).reshape(len(sim), -1)
        order = np.sort(order, axis=1)[:, :most]
        order = np.pad(order, ((0, 0), (0, most - order.shape[1])), constant_values=low)
        some = order < low
        return np.where(some, (1 << 20) - (order >> 40), -1), np.where(some, self.every_id[np.where(some, order & ((1 << 40) - 1), 0)], -1)

    def best(self, line: str, most: int) -> list[tuple[int, int]]:
        """``(sim, a_id)`` of the ``most`` claims most like a line; ties to the smaller id."""
        packed = line.replace(" ", "")
        self.forward.fill(0)
        self.backward.fill(0)
        self._add(*np.unique(grams_of(packed), return_counts=True))
        both = np.maximum(len(packed) - 1 + self.length.astype(np.int64) - 1, 1)
        sim = np.floor(2 * np.maximum(self.forward, self.backward) / both * 100 + 0.5).astype(np.int64)
        sim[(self.length < 2) | (len(packed) < 2)] = 0
        same = [i for i in np.flatnonzero(self.length == len(packed)).tolist() if packed and self.texts[i].replace(" ", "") == packed]
        sim[same] = 100
        plain, numbers = digit_words(line)
        family = self.family.get(plain)
        if family:
            equal = set(same)
            members = np.array(family)
            likes = sim[members].copy()
            sim[members] = 0
            floor = np.sort(np.partition(sim, -most)[-most:])[0] if len(sim) > most else -1
            kept: list[int] = []
            for k in np.argsort(-likes, kind="stable").tolist():
                if likes[k] < floor or (len(kept) >= most and likes[k] < kept[most - 1]):
                    break  # what it loses can only take it further down
                i = family[k]
                apart = sum(abs(numbers[w] - self.numbers[i][w]) for w in numbers.keys() | self.numbers[i].keys())
                loss = min(SIBLING_MOST, SIBLING_STEP * apart)
                sim[i] = max(0, int(likes[k]) - (loss if i in equal else 2 * loss))
                kept = sorted([*kept, int(sim[i])], reverse=True)[:most]
        order = np.lexsort((self.first_id, -sim)) if len(sim) <= 4 * most else self._top(sim, most)
        found = [(int(sim[i]), a_id) for i in order[:most].tolist() for a_id in self.ids[i]]
        return sorted(found, key=lambda x: (-x[0], x[1]))[:most]

    def _top(self, sim: np.ndarray, most: int) -> np.ndarray:
        least = np.partition(sim, len(sim) - most)[len(sim) - most]
        at = np.flatnonzero(sim >= least)
        return at[np.lexsort((self.first_id[at], -sim[at]))]


def _search(most: int):
    def search(lines: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(lines) and len(stored):
            posted = Posted(stored.iloc[0])
            for rest, group in lines.groupby("rest", sort=False)["line"]:
                alone, codes = [], []
                for line in group:
                    code = line[: -len(rest) - 1] if len(rest) < len(line) else ""
                    together = rest and code.split() == [code] and line.replace(" ", "") not in posted.packed
                    (codes if together else alone).append(code if together else line)
                if len(codes) == 1:
                    alone, codes = [*alone, f"{codes[0]} {rest}"], []
                for line in alone:
                    found = posted.best(line, most)
                    out.append((line, [sim for sim, _ in found], [a_id for _, a_id in found]))
                if codes:
                    sims, ids = posted.best_of_codes(codes, rest, most)
                    n = int((sims[0] >= 0).sum())  # as many for every line
                    out += [(f"{c} {rest}", s, i) for c, s, i in zip(codes, sims[:, :n], ids[:, :n])]
        return pd.DataFrame(out, columns=["line", "sims", "ids"])

    return search


def closest_claims(lines: DataFrame, claims: DataFrame, most: int = 8, block: int = BLOCK, lines_a_task: int = LINES) -> DataFrame:
    """``line, pos, a_id, sim``: for each distinct ``line`` (a normalised description) the claims most like it.

    ``claims`` has ``a_id, a_cleaned``.  The likeness is the better of both directions, less the penalty for
    differing numbers, less that penalty once more, and 0 at least; claims without any are listed
    too where there are no better ones.  Ties go to the smaller a_id.
    """
    place = F.row_number().over(Window.partitionBy("a_cleaned").orderBy("a_id"))
    firsts = claims.select("a_id", "a_cleaned").withColumn("at", place).filter(F.col("at") <= most)
    texts = settle(firsts.groupBy("a_cleaned").agg(F.array_sort(F.collect_list("a_id")).alias("ids")), "claim-texts")
    blocks = max(1, -(-texts.count() // block))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    store = settle(texts.withColumn("block", dealt("a_cleaned", blocks)).repartition(blocks, "block").groupBy("block").applyInPandas(build, STORE), "claim-store")
    wanted = settle(lines.select("line").distinct().withColumn("rest", F.regexp_replace("line", LEADING_CODE, "")), "lines")
    n, tasks = wanted.count(), 2 * lines.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-n // lines_a_task), min(-(-tasks // blocks), -(-n // 50)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # Lines of one rest go to one task, unless they are very many.
    many = settle(wanted.groupBy("rest").agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER), "many-lines")
    salt = F.pmod(F.xxhash64("line"), F.coalesce(F.ceil(F.col("n") / TOGETHER), F.lit(1)))
    left = wanted.join(many, "rest", "left").select("line", "rest", F.pmod(F.xxhash64("rest", salt), F.lit(chunks)).cast("int").alias("chunk"))
    left = left.withColumn("block", every(blocks))
    right = store.withColumn("chunk", every(chunks))
    key = ["block", "chunk"]
    found = left.repartition(blocks * chunks, *key).groupBy(*key).cogroup(right.repartition(blocks * chunks, *key).groupBy(*key)).applyInPandas(_search(most), FOUND)
    pairs = lambda sims, ids: F.zip_with(sims, ids, lambda s, i: F.struct((-s).alias("unlike"), i.alias("a_id")))
    if blocks > 1:  # sent as two lists, which are half as wide as their pairs
        found = found.groupBy("line").agg(F.collect_list(F.struct("sims", "ids")).alias("lists"))
        best = F.slice(F.array_sort(F.flatten(F.transform("lists", lambda x: pairs(x["sims"], x["ids"])))), 1, most)
    else:
        best = pairs(F.col("sims"), F.col("ids"))
    found = found.select("line", best.alias("best"))
    each = found.select("line", F.posexplode("best").alias("pos", "x"))
    return each.select("line", (F.col("pos") + 1).alias("pos"), "x.a_id", (-F.col("x.unlike")).alias("sim"))
