"""Lines that differ in a leading code only are searched together, with what each would find alone."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_oracle import compare

from tallyspark.operators import coverage, reverse


def store(seed, n=400):
    rng = random.Random(seed)
    words = ["lamp", "desk", "rod", "oak", "7mm", "8mm", "11", "v12", "aaaa", "k1", "x"]
    texts = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)} | {f"unlisted curio {k}" for k in range(60)} | {"v12 7mm lamp 11", "v 7 oak rod", ""})
    ids = [sorted(rng.sample(range(10_000), rng.randint(1, 8))) for _ in texts]
    return reverse.build(pd.DataFrame({"block": 0, "a_cleaned": texts, "ids": ids}))


@pytest.mark.parametrize("most", [1, 3, 8])
@pytest.mark.parametrize("cells", [300, 2_000_000])
def test_codes_together_equal_each_alone(monkeypatch, most, cells):
    monkeypatch.setattr(reverse, "CELLS", cells)
    posted, rng = reverse.Posted(store(most).iloc[0]), random.Random(1)
    for rest in ("lamp 7mm", "oak rod", "7mm lamp 11", "v12 desk", "x", "unlisted curio 7", "aaaa aaaa 8mm", "never seen", "11"):
        codes = [f"v{rng.randint(0, 30)}" for _ in range(20)] + ["k1", "11", "7mm", "unlisted1curio", "aaaa1aaaa"]
        codes = [c for c in codes if f"{c} {rest}".replace(" ", "") not in posted.packed]
        sims, ids = posted.best_of_codes(codes, rest, most)
        for c, s, i in zip(codes, sims.tolist(), ids.tolist()):
            assert list(zip(s, i)) == posted.best(f"{c} {rest}", most)


def test_many_codes_are_one_search(monkeypatch):
    alone = []
    best = reverse.Posted.best
    monkeypatch.setattr(reverse.Posted, "best", lambda self, line, most: alone.append(line) or best(self, line, most))
    lines = [f"vnd{k:04d} oak rod 7mm" for k in range(300)] + ["oak rod 7mm"]
    found = reverse._search(8)(pd.DataFrame({"line": lines, "rest": "oak rod 7mm"}), store(5))
    assert alone == ["oak rod 7mm"] and sorted(found["line"]) == sorted(lines)
    assert all(len(s) == len(i) == 8 and (np.diff(s) <= 0).all() for s, i in zip(found["sims"], found["ids"]))


def test_unused_names(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")], "b_row long, b_raw_name string")
    seen = "b_row long, raw_name string"
    data = [("STRONG", [(1, "a")], (1, "a")), ("CONFIRMED", [(3, "b"), (1, "a")], None), ("PROBABLE", [(4, "c")], (4, "c")), ("STRONG", [(4, "c")], (5, "c"))]
    results = spark.createDataFrame(data, f"status string, candidates array<struct<{seen.replace(' long', ':long').replace(' string', ':string')}>>, chosen struct<b_row:long,raw_name:string>")
    assert [r[0] for r in coverage.unused_names(rows, results).collect()] == ["a"]


def test_reverse_search_all_equals_sql(spark):
    compare(spark, "reverse_search_all")


def test_a_rest_of_very_many_lines_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(reverse, "TOGETHER", 10)
    lines = spark.range(200).select(F.concat(F.lit("v"), F.col("id").cast("string"), F.lit(" oak rod")).alias("line"))
    claims = spark.createDataFrame([(i, f"oak rod {i % 7}") for i in range(30)], "a_id long, a_cleaned string")
    got = sorted(map(tuple, reverse.closest_claims(lines, claims, 3, 4, 30).collect()))
    monkeypatch.setattr(reverse, "TOGETHER", 10_000)
    assert got == sorted(map(tuple, reverse.closest_claims(lines, claims, 3).collect())) and len(got) == 600
