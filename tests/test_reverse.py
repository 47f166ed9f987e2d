"""The claims closest to each line, against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import similarity
from tallyspark.operators import reverse

WORDS = ["lamp", "desk", "lid", "rod", "7mm", "8mm", "x9", "44", "oak", "aa", "a", "aaaa", "6203", "6204"]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(n)]


def every_pair(spark, lines, claims, most):
    """As one line is searched: all scores by column functions, sorted."""
    a, b = F.col("a"), F.col("line")
    pairs = spark.createDataFrame([(line, i, t) for line in sorted(set(lines)) for i, t in claims], "line string, a_id long, a string")
    best = F.greatest(similarity.similarity(a, b), similarity.similarity(b, a)) - similarity.sibling_penalty(a, b)
    out = {}
    for r in pairs.select("line", "a_id", F.greatest(F.lit(0), best).alias("sim")).collect():
        out.setdefault(r["line"], []).append((-r["sim"], r["a_id"]))
    return {(line, pos, i, -s) for line, found in out.items() for pos, (s, i) in enumerate(sorted(found)[:most], 1)}


@pytest.mark.parametrize("most,block,per_task", [(8, 50_000, 20_000), (3, 20, 15), (1, 7, 1000)])
def test_closest_claims_equal_every_pair(spark, most, block, per_task):
    claims = [(i, t) for i, t in enumerate(texts(120, 1) + ["", "a", "lamp oak"] + ["lamp desk 7mm"] * 12 + [f"oak rod {k}" for k in range(30)])]
    lines = [*texts(50, 2), "", "a", "aaa", "unseen words", "lamp desk 8mm", "lampdesk7mm", "oak rod 12", "oak rod 12 13"]
    got = reverse.closest_claims(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame(claims, "a_id long, a_cleaned string"), most, block, per_task)
    assert {tuple(r) for r in got.collect()} == every_pair(spark, lines, claims, most)


def test_empty_sides(spark):
    lines, claims = spark.createDataFrame([("lamp",)], "line string"), spark.createDataFrame([(1, "lamp")], "a_id long, a_cleaned string")
    assert reverse.closest_claims(lines.limit(0), claims).count() == 0
    assert reverse.closest_claims(lines, claims.limit(0)).count() == 0
    assert [tuple(r) for r in reverse.closest_claims(lines, claims).collect()] == [("lamp", 1, 1, 100)]
