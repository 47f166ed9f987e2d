"""The blockwise pool against one that looks at every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import similarity
from tallyspark.operators import fuzzy, matching

WORDS = ["lamp", "desk", "lid", "rod", "cup", "tray", "hose", "cork", "7mm", "8mm", "x9", "44", "oak", "tin"]


def texts(n, seed):
    rng = random.Random(seed)
    made = {" ".join(rng.choices(WORDS, weights=[9, 8, 7, 6] + [1] * 10, k=rng.randint(1, 5))) for _ in range(n)}
    return sorted(made | {"lamp", "lamp lamp", "a", "aa", "aaaa"})


def every_pool(spark, claims, keys, size, floor):
    """All pairs: weigh shared words, order, cut, score."""
    words = {k: set(k.split()) for k, _, _ in keys}
    df = {w: sum(w in s for s in words.values()) for w in set().union(*words.values())} if keys else {}
    idf = {w: math.floor(math.log(1 + len(keys) / n) * 1_000_000 + 0.5) for w, n in df.items()}
    found = []
    for a in claims:
        own = list(dict.fromkeys(a.split()))
        touched = []
        for k, rank, row in keys:
            shared = [i for i, w in enumerate(own) if w in words[k]]
            if shared:
                touched.append((-sum(idf[own[i]] for i in shared), shared[0], rank, row, k))
        best = sorted(touched)[:size]
        if len(touched) <= size:
            best = sorted(best, key=lambda x: x[1:])
        found += [(a, x[4], i) for i, x in enumerate(best, 1)]
    pairs = spark.createDataFrame(found, "a_key string, key string, pool_pos int")
    scored = pairs.withColumn("sim", similarity.engine_score(F.col("a_key"), F.col("key")))
    return {tuple(r) for r in scored.filter(F.col("sim") >= floor).collect()}


@pytest.mark.parametrize("size,block,claim_block", [(400, 100_000, 400), (5, 100_000, 20), (5, 40, 25), (60, 30, 400)])
def test_pool_equals_every_pair(spark, size, block, claim_block):
    rng = random.Random(size)
    keys = [(k, rng.randint(0, 1), row) for row, k in enumerate(texts(150, 1))]
    claims = [*texts(60, 2), "unseen words", "lamp unseen"]
    table = spark.createDataFrame(keys, "key string, key_rank int, b_row long")
    wanted = spark.createDataFrame([(a,) for a in claims], "a_key string")
    got = fuzzy.fuzzy_scores(wanted, table, matching.token_idf, 30, size, block, claim_block)
    assert {tuple(r) for r in got.select("a_key", "key", "pool_pos", "sim").collect()} == every_pool(spark, claims, keys, size, 30)


def test_empty_sides(spark):
    keys = spark.createDataFrame([("lamp", 0, 1)], "key string, key_rank int, b_row long")
    wanted = spark.createDataFrame([("lamp",)], "a_key string")
    assert fuzzy.fuzzy_scores(wanted, keys.limit(0), matching.token_idf, 30).count() == 0
    assert fuzzy.fuzzy_scores(wanted.limit(0), keys, matching.token_idf, 30).count() == 0


def test_a_pair_is_never_a_row(spark):
    keys = spark.createDataFrame([("lamp", 0, 1)], "key string, key_rank int, b_row long")
    plan = fuzzy.fuzzy_scores(spark.createDataFrame([("lamp",)], "a_key string"), keys, matching.token_idf, 30)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
