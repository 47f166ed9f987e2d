"""For each claim's description the descriptions of the costing side that share its rarest words.

Only words that claims hold can weigh.  Descriptions that hold the same of these are one kind: a claim
weighs them alike, and of a kind only the first can be in a pool.  Likewise claims of the same words
have the same pool.  So pools are found from kinds, down to the places in them, and only what is in a
claim's pool is compared with it.

Kinds, and descriptions kind by kind, are stores of blocks, built once and written: a row holds a
block's words and what they are posted on as packed arrays.  Claims go to the blocks they need, many
thousands to a task, and a task reads its block's arrays as they are.  A pair of descriptions becomes a
row only if it reaches the floor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.functions.similarity import SIBLING_MOST, SIBLING_STEP
from tallyspark.plans.settings import FUZZY_POOL
from tallyspark.sources.shared import settle

#: Kinds of a block, and claims' descriptions that meet it in one task; fewer, down to
#: ``FEWEST_CLAIMS``, where tasks would be idle otherwise.
BLOCK, CLAIM_BLOCK, FEWEST_CLAIMS = 100_000, 20_000, 40
#: Descriptions of a block at most: their texts and words are Python's objects while a block is built or read, and every core has one.
KEY_BLOCK = 25_000
#: Descriptions that the kinds of a block hold, in blocks; pairs that one task scores, about, and so returns at once.
KIND_BLOCKS, MOST_PAIRS = 50, 250_000
#: Rows of a claim and a block that one task merges.
MERGE = 2_000
#: Words of the vocabulary up to which it is sent to every task.
BROADCAST_WORDS = 500_000

SCORED = "a_key string, key string, pool_pos int, sim int"
PARTIAL = "a_key string, sure boolean, touched long, places binary"
POOLS = "a_key string, block int, n int, at binary, pos binary"
#: How a pool is ordered: by weight, first shared word, first place among the costing rows.  Then where it is stored.
PLACE = np.dtype([("weight", np.int64), ("touch", np.int64), ("key_rank", np.int64), ("b_row", np.int64), ("block", np.int32), ("at", np.int32)])

#: The stores' arrays, and how they are packed.
KIND_ARRAYS = {"n": np.int32, "block": np.int32, "start": np.int32, "place": np.int32, "key_rank": np.int32, "b_row": np.int64, "posting": np.int32, "posting_from": np.int64}
ARRAYS = {"has": np.int32, "times": np.int32, "has_from": np.int64, "length": np.int32, "gram": np.uint16, "digit": np.bool_}
KIND_STORE = "part int, words string, " + ", ".join(f"{name} binary" for name in KIND_ARRAYS)
STORE = "block int, keys string, words string, " + ", ".join(f"{name} binary" for name in ARRAYS)


def _packed(arrays: dict[str, np.ndarray], kinds: dict) -> dict[str, list[bytes]]:
    return {name: [arrays[name].astype(kind).tobytes()] for name, kind in kinds.items()}


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the word of every occurrence, and the words."""
    words = [t.split() for t in texts]
    ids, vocabulary = pd.factorize(pd.Series([w for ws in words for w in ws], dtype=object))
    return np.repeat(np.arange(len(texts)), [len(ws) for ws in words]), ids, vocabulary


def build_kinds(alone: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``part, kind, n, block, start, ranks, rows`` of one block -> its row of the store of kinds.

    Places among all costing rows are only needed where pools of several blocks are merged.
    """

    def build(kinds: pd.DataFrame) -> pd.DataFrame:
        of, ids, vocabulary = _words_of(kinds["kind"].tolist())
        by_word = np.argsort(ids, kind="stable")
        key_rank, b_row = np.concatenate(kinds["ranks"].tolist()), np.concatenate(kinds["rows"].tolist())
        place = np.empty(len(b_row), np.int64)
        place[np.lexsort((b_row, key_rank))] = np.arange(len(b_row))
        arrays = {
            "n": kinds["n"].to_numpy(),
            "block": kinds["block"].to_numpy(),
            "start": kinds["start"].to_numpy(),
            "place": place,
            "key_rank": key_rank[:0] if alone else key_rank,
            "b_row": b_row[:0] if alone else b_row,
            "posting": of[by_word],
            "posting_from": np.searchsorted(ids[by_word], np.arange(len(vocabulary) + 1)),
        }
        return pd.DataFrame({"part": kinds["part"].iloc[:1].to_numpy(), "words": ["\n".join(vocabulary)], **_packed(arrays, KIND_ARRAYS)})

    return build


class Kinds:
    """Kinds with their words' postings and the places of their descriptions: a row of the store of kinds."""

    def __init__(self, stored: pd.Series):
        self.word = {w: i for i, w in enumerate(stored["words"].split("\n"))}
        for name, kind in KIND_ARRAYS.items():
            setattr(self, name, np.frombuffer(stored[name], kind))
        self.from_ = np.cumsum(self.n, dtype=np.int64) - self.n
        self.first = self.place[self.from_]
        self.weight, self.touch = np.zeros(len(self.n), np.int64), np.zeros(len(self.n), np.int64)

    def postings(self, word: int) -> np.ndarray:
        return self.posting[self.posting_from[word] : self.posting_from[word + 1]]

    def pool(self, words: list[dict], size: int) -> tuple[int, np.ndarray, np.ndarray]:
        """How many descriptions an essential word touches; of the best ``size`` the kinds and places, best first."""
        known = [(self.word[w["token"]], w) for w in words if w["token"] in self.word]
        if not any(w["essential"] for _, w in known):
            return 0, np.empty(0, np.int64), np.empty(0, np.int64)
        self.touch.fill(-1)
        for i, w in known:
            if w["essential"]:
                self.touch[self.postings(i)] = 0
        found = np.flatnonzero(self.touch == 0)
        touched = int(self.n[found].sum())
        self.weight[found] = 0
        for i, w in reversed(known):  # the first shared word is written last
            posts = self.postings(i)
            if not w["essential"] and len(posts) > 8 * len(found):
                at = np.minimum(np.searchsorted(posts, found), len(posts) - 1)
                posts = found[posts[at] == found]
            self.weight[posts] += w["idf_micro"]
            self.touch[posts] = w["tok_pos"]
        if len(found) > size:  # each kind has a description
            weight = self.weight[found]
            found = found[weight >= np.partition(weight, len(weight) - size)[len(weight) - size]]
        found = found[np.lexsort((self.touch[found], -self.weight[found]))]
        before = np.cumsum(self.n[found], dtype=np.int64)
        if len(found) and before[-1] > size:
            # All kinds above the level at which the pool is full, and of this level's kinds the first descriptions.
            last = found[np.searchsorted(before, size)]
            level = (self.weight[found] == self.weight[last]) & (self.touch[found] == self.touch[last])
            above, level = found[~level & (before < size)], found[level]
            want = size - int(self.n[above].sum())
            if len(level) > want:
                level = level[np.argpartition(self.first[level], want - 1)[:want]]
            at, kind = self._members(level, np.minimum(self.n[level], want))
            best = np.argpartition(self.place[at], want - 1)[:want] if want < len(at) else slice(None)
            at_above, kind_above = self._members(above, self.n[above])
            at, kind = np.concatenate([at_above, at[best]]), np.concatenate([kind_above, kind[best]])
        else:
            at, kind = self._members(found, self.n[found])
        order = np.lexsort((self.place[at], self.touch[kind], -self.weight[kind]))
        return touched, kind[order], at[order]

    def _members(self, kinds: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _ragged(self.from_[kinds], self.from_[kinds] + n)[0], np.repeat(kinds, n)

    def places(self, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), PLACE)
        out["weight"], out["touch"] = self.weight[kind], self.touch[kind]
        out["key_rank"], out["b_row"] = (self.key_rank[at], self.b_row[at]) if len(self.b_row) else (0, self.place[at])
        out["block"], out["at"] = self.block[kind], self.start[kind] + at - self.from_[kind]
        return out


def build_block(descriptions: pd.DataFrame) -> pd.DataFrame:
    """``block, at, key`` of one block -> its row of the store of descriptions."""
    keys = descriptions.sort_values("at")["key"].tolist()
    n = len(keys)
    of, ids, vocabulary = _words_of(keys)
    v = max(len(vocabulary), 1)
    pair, times = np.unique(of * v + ids, return_counts=True)
    letters = np.frombuffer("".join(keys).replace(" ", "").encode("ascii", "replace"), np.uint8).astype(np.uint16)
    arrays = {
        "has": pair % v,
        "times": times,
        "has_from": np.searchsorted(pair // v, np.arange(n + 1)),
        "length": np.fromiter((len(k) - k.count(" ") for k in keys), np.int64, n),
        "gram": np.append(letters[:-1] * 256 + letters[1:], 0) if len(letters) else np.zeros(1),
        "digit": np.fromiter((any("0" <= c <= "9" for c in w) for w in vocabulary), bool, len(vocabulary)),
    }
    return pd.DataFrame({"block": descriptions["block"].iloc[:1].to_numpy(), "keys": ["\n".join(keys)], "words": ["\n".join(vocabulary)], **_packed(arrays, ARRAYS)})


class Block:
    """Descriptions with their words and their bigrams: a row of the store of descriptions."""

    def __init__(self, stored: pd.Series):
        self.keys = np.array(stored["keys"].split("\n"), object)
        self.word = {w: i for i, w in enumerate(stored["words"].split("\n"))}
        for name, kind in ARRAYS.items():
            setattr(self, name, np.frombuffer(stored[name], kind))
        self.letter_from = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        self.seen = np.zeros(1 << 16, bool)
        self.count = np.zeros(max(len(self.word), 1), np.int64)

    def scores(self, a_key: str, chosen: np.ndarray) -> np.ndarray:
        """The matcher's score of a description with each of ``chosen``; see ``similarity.engine_score``."""
        a = a_key.replace(" ", "")
        if not len(chosen) or not a:
            return np.zeros(len(chosen), np.int64)
        grams = np.frombuffer(a.encode("ascii", "replace"), np.uint8).astype(np.int64)
        grams = grams[:-1] * 256 + grams[1:]
        self.seen[grams] = True
        size = self.length[chosen]
        start = self.letter_from[chosen]
        size = size.astype(np.int64)
        at, begin = _ragged(start, start + np.maximum(size - 1, 0))
        shared = _sums(self.seen[self.gram[at]].astype(np.int64), begin, size > 1)
        self.seen[grams] = False
        pairs = len(a) - 1 + size - 1
        base = np.where((size < 2) | (len(a) < 2), 0, np.floor(2 * shared / np.maximum(pairs, 1) * 100 + 0.5)).astype(np.int64)
        equal = [k for k in np.flatnonzero(size == len(a)) if self.keys[chosen[k]].replace(" ", "") == a]
        base[equal] = 100
        return np.where(base == 100, 100, np.maximum(0, base - self._penalties(a_key, chosen)))

    def _penalties(self, a_key: str, chosen: np.ndarray) -> np.ndarray:
        """Descriptions that differ in words with digits only are siblings."""
        words, strange, strange_plain = a_key.split(), 0, 0
        ids = []
        for w in words:
            i = self.word.get(w)
            if i is None:
                strange += 1
                strange_plain += not any("0" <= c <= "9" for c in w)
            else:
                ids.append(i)
        ids = np.array(ids, np.int64)
        np.add.at(self.count, ids, 1)
        at, begin = _ragged(self.has_from[chosen], self.has_from[chosen + 1])
        word, some = self.has[at], self.has_from[chosen + 1] > self.has_from[chosen]
        mine, plain = self.count[word], ~self.digit[word]
        apart = np.abs(self.times[at] - mine)
        missing = strange + len(ids) - _sums(mine, begin, some)
        missing_plain = strange_plain + (~self.digit[ids]).sum() - _sums(mine * plain, begin, some)
        differ = _sums(apart, begin, some) + missing
        differ_plain = _sums(apart * plain, begin, some) + missing_plain
        self.count[ids] = 0
        return np.where(differ_plain > 0, 0, np.minimum(SIBLING_MOST, differ * SIBLING_STEP))


def _ragged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ranges one after another, and where each range begins."""
    size = end - start
    begin = np.cumsum(size) - size
    return np.repeat(start - begin, size) + np.arange(size.sum()), begin


def _sums(values: np.ndarray, begin: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges; ranges without a value have 0."""
    out = np.zeros(len(begin), np.int64)
    if some.any():
        out[some] = np.add.reduceat(values, begin[some])
    return out


def dealt_pool(a_key: str, places: np.ndarray) -> list[tuple]:
    """A pool in its order -> a row for each block of descriptions: where in it they are, and their numbers."""
    out = []
    order = np.argsort(places["block"], kind="stable")
    blocks, begin = np.unique(places["block"][order], return_index=True)
    for block, part in zip(blocks, np.split(order, begin[1:])):
        out.append((a_key, int(block), len(part), places["at"][part].tobytes(), (part + 1).astype(np.int32).tobytes()))
    return out


def merge_parts(parts: pd.DataFrame, size: int) -> pd.DataFrame:
    """Rows of :data:`PARTIAL`, all of a claim's -> rows of :data:`POOLS`."""
    out: list[tuple] = []
    for a_key, rows in parts.groupby("a_key", sort=False):
        places = np.frombuffer(b"".join(rows["places"]), PLACE)
        places = places[np.lexsort((places["b_row"], places["key_rank"], places["touch"], -places["weight"]))[:size]]
        if not (rows["sure"].any() or rows["touched"].sum() > size):
            places = places[np.lexsort((places["b_row"], places["key_rank"], places["touch"]))]
        out += dealt_pool(a_key, places)
    return pd.DataFrame(out, columns=["a_key", "block", "n", "at", "pos"])


def search_kinds(size: int, whole: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Claims' words and one block of kinds -> their parts, or the pools if there is no other block."""

    def search(claims: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(claims) and len(stored):
            kinds = Kinds(stored.iloc[0])
            for a_key, words, filled in zip(claims["a_key"], claims["words"], claims["filled"].fillna(-1)):
                touched, kind, at = kinds.pool(list(words), size)
                if not whole:  # over ``size`` descriptions weigh at least ``filled``
                    kept = kinds.weight[kind] >= filled
                    kind, at = kind[kept], at[kept]
                places, sure = kinds.places(kind, at), not all(w["essential"] for w in words)
                if not whole:
                    out.append((a_key, sure, touched, places.tobytes()))
                    continue
                if not (sure or touched > size):
                    places = places[np.lexsort((places["b_row"], places["touch"]))]
                out += dealt_pool(a_key, places)
        return pd.DataFrame(out, columns=["a_key", "block", "n", "at", "pos"] if whole else ["a_key", "sure", "touched", "places"])

    return search


def score_block(review_floor: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Claims with what their pools hold of one block, and the block -> the pairs that reach the floor."""

    def score(claims: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        a_keys, chosen, numbers, sims = [], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        if not len(claims) or not len(stored):
            return pd.DataFrame({"a_key": [], "key": [], "pool_pos": [], "sim": []})
        block = Block(stored.iloc[0])
        for a_key, at, pos in zip(claims["a_key"], claims["at"], claims["pos"]):
            at = np.frombuffer(at, np.int32).astype(np.int64)
            sim = block.scores(a_key, at)
            kept = sim >= review_floor
            a_keys.append(np.repeat(np.array([a_key], object), kept.sum()))
            chosen.append(at[kept])
            numbers.append(np.frombuffer(pos, np.int32)[kept])
            sims.append(sim[kept])
        return pd.DataFrame({"a_key": np.concatenate(a_keys), "key": block.keys[np.concatenate(chosen)], "pool_pos": np.concatenate(numbers), "sim": np.concatenate(sims)})

    return score


def vocabulary(kinds: DataFrame, idf: DataFrame) -> DataFrame:
    """``token, df, idf_micro, blocks``: rarity of each word, and the blocks of kinds it occurs in."""
    where = kinds.select(F.col("part").alias("block"), F.explode(text.tokens(F.col("kind"))).alias("token"))
    return where.groupBy("token").agg(F.collect_set("block").alias("blocks")).join(idf, "token")


def described_kinds(firsts: DataFrame, idf: DataFrame, size: int) -> DataFrame:
    """``kind, nth, key, key_rank, b_row``: descriptions by those of their words that ``idf`` has, rarest first.

    Of a kind ``size + 1`` stay, so that it shows where more were touched than a pool holds.
    """
    seen = firsts.select("key", "key_rank", "b_row", F.explode(F.array_distinct(text.tokens(F.col("key")))).alias("token")).join(idf, "token")
    words = F.array_sort(F.collect_list(F.struct((-F.col("idf_micro")).alias("common"), "token")))
    of = seen.groupBy("key", "key_rank", "b_row").agg(F.array_join(F.transform(words, lambda w: w["token"]), " ").alias("kind"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("key_rank", "b_row"))
    return of.withColumn("nth", nth).filter(F.col("nth") <= size + 1)


def weighed_words(claim_keys: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``a_key, words, filled, blocks``: a claim's words, and the blocks its essential words occur in.

    A word of more than ``size`` descriptions fills the pool with weights of at least its
    own (``filled``), so a description can't enter by words that weigh less together; these aren't essential.
    """
    seen = claim_keys.select("a_key", F.posexplode(F.array_distinct(text.tokens(F.col("a_key")))).alias("tok_pos", "token")).join(words, "token")
    of_claim = Window.partitionBy("a_key")
    upwards = of_claim.orderBy("idf_micro", "tok_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.max(F.when(F.col("df") > size, F.col("idf_micro"))).over(of_claim)
    seen = seen.withColumn("filled", filled).withColumn("below", F.sum("idf_micro").over(upwards))
    seen = seen.withColumn("essential", F.col("filled").isNull() | (F.col("below") >= F.col("filled")))
    return seen.groupBy("a_key").agg(
        F.array_sort(F.collect_list(F.struct("tok_pos", "token", "idf_micro", "essential"))).alias("words"),
        F.first("filled").alias("filled"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("essential"), F.col("blocks"))))).alias("blocks"),
    )


def met(claims: DataFrame, visits: DataFrame, store: DataFrame, block: str, claim_block: int) -> tuple[GroupedData, GroupedData]:
    """``claims`` and the blocks of ``store`` they go to, grouped to be searched task by task.

    ``visits`` (``block, n, pairs``) says how many claims go to a block, and to how many pairs.
    """
    tasks = 2 * claims.sparkSession.sparkContext.defaultParallelism
    all_ = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = F.least(F.ceil(F.col("pairs") * tasks / F.sum("pairs").over(all_)), F.ceil(F.col("n") / FEWEST_CLAIMS))
    most = F.greatest(spread, F.ceil(F.col("n") / claim_block), F.ceil(F.col("pairs") / MOST_PAIRS))
    chunks = settle(visits.select(block, most.cast("int").alias("chunks")), "block-visits")
    n_tasks = max(1, chunks.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n")).first()["n"])
    left = claims.join(F.broadcast(chunks), block).withColumn("chunk", F.pmod(F.xxhash64("a_key", F.lit(2)), F.col("chunks")).cast("int")).drop("chunks")
    right = store.join(F.broadcast(chunks), block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return left.repartition(n_tasks, block, "chunk").groupBy(block, "chunk"), right.repartition(n_tasks, block, "chunk").groupBy(block, "chunk")


def fuzzy_scores(
    claim_keys: DataFrame,
    keys: DataFrame,
    idf_of: Callable[[DataFrame], DataFrame],
    review_floor: int,
    size: int = FUZZY_POOL,
    block: int = BLOCK,
    claim_block: int = CLAIM_BLOCK,
) -> DataFrame:
    """``a_key, key, pool_pos, sim`` of each claim description's pool where the floor is reached.

    The pool is the ``size`` descriptions whose shared words weigh most (ties: the
    earliest shared word of the claim, then the order of the costing rows).  ``pool_pos`` counts
    by weight, or by first touch where the pool holds all that were touched.

    ``claim_keys`` (``a_key``) and ``keys`` (``key, key_rank, b_row``) hold normalised
    descriptions.  Claims' words travel to the blocks of kinds that hold one of their essential words, claims to
    the blocks that hold their pools; a task holds one block and at most about ``claim_block`` claims.
    """
    dealt = lambda key, n, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int")
    firsts = keys.groupBy("key").agg(F.min(F.struct("key_rank", "b_row")).alias("first_at")).select("key", "first_at.key_rank", "first_at.b_row")
    firsts = settle(firsts, "descriptions")
    asked = claim_keys.select("a_key", F.posexplode(F.array_distinct(text.tokens(F.col("a_key")))).alias("tok_pos", "token"))
    idf = settle(idf_of(firsts).join(asked.select("token").distinct(), "token", "left_semi"), "vocabulary")
    n_words = idf.count()
    known = F.broadcast(idf) if n_words <= BROADCAST_WORDS else idf

    # Descriptions by their kinds, kinds of the same rare words beside each other.
    kinds = settle(described_kinds(firsts, known, size), "description-kinds")
    held = kinds.agg(F.count("*").alias("all"), F.count_if(F.col("nth") == 1).alias("kinds")).first()
    blocks, parts = max(1, -(-held["all"] // min(block, KEY_BLOCK))), max(1, -(-held["kinds"] // block), -(-held["all"] // (KIND_BLOCKS * block)))
    members = settle(kinds.repartitionByRange(blocks, "kind").withColumn("block", F.spark_partition_id()), "kind-members")
    places = F.array_sort(F.collect_list(F.struct("key_rank", "b_row")))
    listed = members.groupBy("block", "kind").agg(F.count("*").cast("int").alias("n"), places.alias("places"))
    start = F.sum("n").over(Window.partitionBy("block").orderBy("kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    listed = listed.select(dealt("kind", parts, 1).alias("part"), "kind", "n", "block", start.cast("int").alias("start"), F.col("places.key_rank").alias("ranks"), F.col("places.b_row").alias("rows"))
    listed = settle(listed, "kinds")
    kind_store = settle(listed.repartition(parts, "part").groupBy("part").applyInPandas(build_kinds(parts == 1), KIND_STORE), "kind-store")
    numbered = members.join(listed.select("block", "kind", "start"), ["block", "kind"]).select("block", (F.col("start") + F.col("nth")).alias("at"), "key")
    store = settle(numbered.repartition(blocks, "block").groupBy("block").applyInPandas(build_block, STORE), "block-store")

    # Claims of the same known words in the same order share a pool.
    wish = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_pos", "token"))), lambda w: w["token"]), " ")
    wishes = settle(asked.join(known.select("token"), "token").groupBy("a_key").agg(wish.alias("wish")), "claim-wishes")
    words = settle(vocabulary(listed, idf), "kind-words")
    words = F.broadcast(words) if n_words * parts <= BROADCAST_WORDS else words
    wanted = settle(weighed_words(wishes.select(F.col("wish").alias("a_key")).distinct(), words, size), "claim-words")
    visits = wanted.select("a_key", "words", "filled", F.explode("blocks").alias("part"))
    left, right = met(visits, visits.groupBy("part").agg(F.count("*").alias("n"), F.count("*").alias("pairs")), kind_store, "part", claim_block)
    pools = left.cogroup(right).applyInPandas(search_kinds(size, parts == 1), POOLS if parts == 1 else PARTIAL)
    if parts > 1:
        pools = settle(pools, "fuzzy-parts")
        groups = max(1, -(-pools.count() // MERGE))
        pools = pools.groupBy(dealt("a_key", groups, 3).alias("part")).applyInPandas(lambda rows: merge_parts(rows, size), POOLS)
    pools = settle(pools.withColumnRenamed("a_key", "wish"), "fuzzy-pools")

    claims = wishes.groupBy("wish").agg(F.count("*").alias("claims"))
    load = pools.join(claims, "wish").groupBy("block").agg(F.sum("claims").alias("n"), F.sum(F.col("claims") * F.col("n")).alias("pairs"))
    left, right = met(wishes.join(pools.drop("n"), "wish").select("a_key", "block", "at", "pos"), load, store, "block", claim_block)
    return left.cogroup(right).applyInPandas(score_block(review_floor), SCORED)
