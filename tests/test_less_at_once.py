"""What a comparison holds at a time: small blocks in Python, few pairs of a claim, no costing rows that nothing reads."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_oracle import compare

from tallyspark.operators import fuzzy, matching
from tallyspark.plans.settings import FUZZY_POOL
from tallyspark.sources import shared


def described(spark, n=600):
    rng = random.Random(n)
    words = [f"w{k}" for k in range(25)]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(2, 5))) for _ in range(n)})
    keys = [(t, k % 2, 10 * k + j) for k, t in enumerate(texts) for j in range(1 + k % 4)]
    claims = [(k, " ".join(rng.choice(words) for _ in range(3))) for k in range(40)]
    return spark.createDataFrame(claims, "a_id long, a_cleaned string"), spark.createDataFrame(keys, "key string, key_rank int, b_row long")


def kept_in(tables):
    def settle(df, name):
        tables[name] = shared.settle(df, name)
        return tables[name]

    return settle


def test_no_block_of_descriptions_is_larger_than_its_bound(spark, monkeypatch):
    claims, keys = described(spark)
    asked = claims.select(F.col("a_cleaned").alias("a_key")).distinct()
    rows = lambda: sorted(map(tuple, fuzzy.fuzzy_scores(asked, keys, matching.token_idf, 30).collect()))
    whole, tables = rows(), {}
    monkeypatch.setattr(fuzzy, "KEY_BLOCK", 50)
    monkeypatch.setattr(fuzzy, "settle", kept_in(tables))
    assert rows() == whole
    assert tables["block-store"].count() > 5


@pytest.mark.parametrize("stored", [1, 3, 50])
def test_pairs_that_cannot_count_are_not_sent(spark, monkeypatch, stored):
    claims, keys = described(spark)
    monkeypatch.setattr(matching, "STORED", stored)
    tables = {}
    monkeypatch.setattr(matching, "settle", kept_in(tables))
    got = sorted(map(tuple, matching.fuzzy_hits(claims, keys, 30).select("a_id", "b_row", "sim", "o1", "o2").collect()))
    of_key = {}
    for key, rank, row in keys.collect():
        of_key.setdefault(key, []).append((rank, row))
    want, pairs = [], {}
    asked = claims.select(F.col("a_cleaned").alias("a_key")).distinct()
    for a_key, key, pos, sim in fuzzy.fuzzy_scores(asked, keys, matching.token_idf, 30).collect():
        pairs.setdefault(a_key, []).extend((-sim, pos, rank, row) for rank, row in of_key[key])
    for a_id, a_key in claims.collect():
        want += [(a_id, row, -unlike, pos, rank) for unlike, pos, rank, row in sorted(pairs.get(a_key, []))[:stored]]
    assert got == sorted(want) and len(pairs) > 20
    most = tables["fuzzy-scores"].groupBy("a_key").count().agg(F.max("count")).first()[0]
    assert most <= 2 * stored <= FUZZY_POOL


@pytest.mark.parametrize("name", ["match_status", "match_notes", "audit_filter_sort"])
def test_costing_rows_go_where_only_results_are_wanted(spark, name):
    folder = shared.shared_dir(spark).removeprefix("file://")
    kept = lambda: {x for x in os.listdir(folder) if x.startswith("costing-rows-")}
    before = kept()
    compare(spark, name)
    assert kept() == before


def test_items_go_and_records_travel_as_rows(spark):
    folder = shared.shared_dir(spark).removeprefix("file://")
    kept = lambda kind: {x for x in os.listdir(folder) if x.startswith(kind)}
    before, records = kept("costing-items-"), kept("linked-records-")
    compare(spark, "exposure")
    assert kept("costing-items-") == before
    assert len(kept("linked-records-") - records) == 1
