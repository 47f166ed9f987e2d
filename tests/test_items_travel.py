"""What a comparison sends about: lines once, costing rows without their texts, nothing that is kept when it was written."""

import random

import pytest
from pyspark.sql import functions as F
from test_hot_keys import SCHEMA, random_rows
from test_lighter_queries import refuse
from test_oracle import DATA, compare

from tallyspark.operators import matching
from tallyspark.plans import tables
from tallyspark.sources.shared import settle


@pytest.mark.parametrize("name", ["match_status", "exposure", "ledger", "apply_picks", "detail_view"])
def test_no_comparison_brings_texts_to_every_costing_row(spark, monkeypatch, name):
    monkeypatch.setattr(matching, "prepare_costing", refuse)
    monkeypatch.setattr(matching, "named_rows", refuse, raising=False)
    compare(spark, name)


def test_lines_are_dealt_out_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.costing(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning(l_partkey" in x]
    assert len(lines) == 1


def test_what_was_shuffled_goes_when_a_table_is_written(spark):
    def shuffled():
        tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
        return tracker.shuffleStatuses().size()

    spark.sparkContext._jvm.System.gc()
    before = shuffled()
    for k in range(5):
        settle(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count(), "counts")
    assert shuffled() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("stored", [1, 3, 7, 50])
def test_items_give_the_first_rows_of_every_key(spark, monkeypatch, stored):
    monkeypatch.setattr(matching, "STORED", stored)
    rng = random.Random(stored)
    rows = [(k, rng.choice(["", "", "VND0001 "]) + name, price, code) for k, name, price, code in random_rows(stored, 500, 1000)]
    rng.shuffle(rows)
    b = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).repartition(5)
    whole = matching.first_rows(matching.description_keys(matching.prepare_costing(b, alt_keys=True)))
    items = settle(matching.costing_items(matching.costing_rows(b), alt_keys=True), "items")
    keys = matching.item_keys(items)
    assert sorted(map(tuple, keys.select("key", "key_rank", "b_row").collect())) == sorted(map(tuple, whole.select("key", "key_rank", "b_row").collect()))
    item_of = {x["b_row"]: (r["first_row"], x["b_price"]) for r in items.collect() for x in r["rows"]}
    assert all(item_of[r["b_row"]] == (r["first_row"], r["b_price"]) for r in keys.collect())


def test_costing_rows_of_a_ledger_travel_once(spark):
    from tallyspark.operators import coverage

    costing = spark.createDataFrame([(k, f"lamp {k}", "lamp", 2.0, 1.0, None) for k in range(9)], "b_row long, b_raw_name string, b_cleaned string, b_price double, qty double, b_code string")
    kind = "a_row long, a_raw_name string, a_price double, status string, candidates array<struct<b_row:bigint>>, chosen struct<b_row:bigint>"
    results = spark.createDataFrame([(2, "lamp", 2.0, "STRONG", [(1,), (3,)], (1,)), (3, "lamp", None, "STRONG", [(3,)], (3,))], kind)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = coverage.ledger(costing, results, spark.createDataFrame([(2, 5.0)], "a_row long, qty double"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        shown = {r["b_row"]: (r["claimed_qty"], r["claim_rows"], r["ref_a_price"]) for r in lines.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    assert shown == {k: (5.0, "2" if k == 1 else "2, 3", 2.0) if k in (1, 3) else (None, "", None) for k in range(9)}
