"""Codes on very many rows, money at exact halves: results that mustn't depend on sizes or orders."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import matching, report, valuation
from tallyspark.plans.reconcile import Comparison
from tallyspark.plans.settings import STORED, Settings

SCHEMA = "row_num long, raw_name string, raw_price string, raw_code string, raw_qty double"


def sides(spark, claims, costing):
    make = lambda rows: spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA)
    return matching.prepare_claims(make(claims), "none"), matching.prepare_costing(make(costing), alt_keys=False)


def random_rows(seed, n, first):
    """Few names and codes, so that every code stands on many rows; some rows carry two codes."""
    rng = random.Random(seed)
    names = ["oak desk lamp", "oak desk lamp tall", "steel tray", "steel tray 20x30", "steel tray 20x40", "cork lid KX2210", "lamp shade KX2210 ZB7001", "rope"]
    return [(first + k, rng.choice(names), "5", rng.choice([None, None, "KX-2210", "ZB-7001", "QQ-9000", ""])) for k in range(n)]


@pytest.mark.parametrize("heavy", [matching.HEAVY, 40])
def test_items_tell_what_every_pair_tells(spark, heavy):
    a, b = sides(spark, random_rows(1, 60, 2), random_rows(2, 400, 1000))
    pairs = matching.code_hits(a, b).collect()
    told, hits = matching.code_stage(a, b, heavy)
    by_claim = {}
    for r in pairs:
        by_claim.setdefault(r["a_id"], []).append(r)
    got = {r["a_id"]: r for r in told.collect()}
    assert set(got) == set(by_claim) and len(got) == told.count()
    listed = {}
    for r in hits.collect():
        listed.setdefault(r["a_id"], set()).add((r["b_row"], r["kind"], r["sim"], r["code_pos"], r["code"]))
    group = {"strong": 0, "weak": 1, "conflict": 2}
    for claim, rows in by_claim.items():
        for kind in group:
            assert got[claim][f"n_{kind}"] == sum(r["kind"] == kind for r in rows)
        best = sorted(rows, key=lambda r: (group[r["kind"]], -r["sim"], r["code_pos"], r["b_row"]))[: 2 * STORED]
        assert listed[claim] == {(r["b_row"], r["kind"], r["sim"], r["code_pos"], r["code"]) for r in best}
        notes = [r["note"] for r in sorted(rows, key=lambda r: (r["code_pos"], r["b_row"])) if r["note"]]
        assert (got[claim]["code_notes"] or []) == notes[:STORED] and got[claim]["more_notes"] == max(0, len(notes) - STORED)
    assert max(map(len, by_claim.values())) > 2 * STORED


def test_one_code_on_all_rows_of_both_sides(spark):
    """40,000 x 40,000 rows of one code are 1.6 thousand million pairs, and twelve pairs of items."""
    n = 40_000
    name = F.element_at(F.array(*[F.lit(x) for x in ("oak desk lamp", "oak desk lamp tall", "steel tray", "rope")]), (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(n).select(F.col("id").alias("row_num"), name.alias("raw_name"), F.lit("5").alias("raw_price"), F.lit("KX-2210").alias("raw_code"), F.lit(1.0).alias("raw_qty"))
    c = Comparison(rows, rows, Settings(code_strip="none"))
    counts = {tuple(r) for r in c.stages[0].select("n_strong", "n_weak", "n_conflict").distinct().collect()}
    assert counts == {(n // 2, 0, n // 2), (n // 4, 0, 3 * n // 4)}
    shown = c.results.select(F.size("candidates").alias("n"), F.size("notes").alias("notes"), "status").distinct().collect()
    assert {(r["n"], r["status"]) for r in shown} == {(STORED, "CONFIRMED")} and {r["notes"] for r in shown} == {STORED + 3}


def test_every_code_in_item_signatures_counts_once(spark):
    a, b = sides(spark, [(2, "lamp KX2210 ZB7001", "5", "KX-2210")], [(9, "lamp KX2210 ZB7001", "5", "ZB-7001"), (10, "lamp", "5", "ZB7001")])
    told, hits = matching.code_stage(a, b)
    row = told.first()
    assert (row["n_strong"], row["n_weak"], row["n_conflict"]) == (2, 0, 0)
    assert {(r["b_row"], r["code"]) for r in hits.collect()} == {(9, "KX2210"), (10, "ZB7001")}


def linked(spark, records):
    """One claim with the given (price, qty) records, in this order, over several partitions."""
    kind = "a_id long, candidates array<struct<b_row:bigint,raw_name:string,price:double,matched_code:string>>"
    results = spark.createDataFrame([(1, [(k, "x", p, None) for k, (p, _) in enumerate(records)])], kind)
    qty = spark.createDataFrame([(k, q) for k, (_, q) in enumerate(records) if q is not None], "b_row long, qty double").repartition(4)
    return valuation.valuation(results, qty).first()["weighted_avg"]


def test_an_exact_half_cent_goes_up_in_any_order(spark):
    # 4,690 cents over 4 units and 2,345 over 4: halves once exactly 1172.5 cents, once 586.25.
    assert linked(spark, [(10.0, 3.0), (16.90, 1.0)]) == 11.73
    assert linked(spark, [(0.01, None), (0.02, None)]) == 0.02
    # Fifteen records worth exactly half a cent more than 2,311.98 a unit.
    rng = random.Random(5)
    records = [(rng.randint(200_000, 260_000), rng.randint(1, 60)) for _ in range(14)]
    units = sum(u for _, u in records) + 1
    if units % 2:
        records.append((231_198, 1))
        units += 1
    records.append((231_198 * units + units // 2 - sum(p * u for p, u in records), 1))
    assert 2 * sum(p * u for p, u in records) == units * 462_397
    for _ in range(4):
        rng.shuffle(records)
        priced = [(p, u) for p, u in records if p > 0]
        total, n = sum(p * u for p, u in priced), sum(u for _, u in priced)
        assert linked(spark, [(p / 100, float(u)) for p, u in records]) == (2 * total + n) // (2 * n) / 100


def test_totals_are_exact(spark):
    rows = spark.range(200_000).select(F.lit("CONFIRMED").alias("status"), F.lit(0.1).alias("a_price"), F.lit(None).cast("double").alias("b_price"), F.lit(0.01).alias("difference"))
    for parts in (1, 7):
        r = {x["status"]: x for x in report.status_money(rows.repartition(parts)).collect()}["CONFIRMED"]
        assert (r["sum_a"], r["sum_b"], r["sum_diff"]) == (20_000.0, None, 2_000.0)
