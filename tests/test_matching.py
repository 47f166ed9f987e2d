"""Whole comparisons on small tables."""

import pytest

from tallyspark.plans.reconcile import Comparison
from tallyspark.plans.settings import STATUSES, Settings

SCHEMA = "row_num long, raw_name string, raw_price string, raw_code string, raw_qty double"
# A made-up garden shop: each claim stands for one way of being matched or not.
CLAIMS = [
    (5, "GX700 Watering Can Zinc 9 l", "18.40"),  # the same words in the same order
    (6, "GX701 Trowel Ash Handle Wide", "7"),  # one word more on the costing side
    (7, "GX702 Hose Reel Wall Mounted 30 m", "64,90"),  # the same words in another order
    (8, "GX703 Twine Jute Ball", "PHP 2.10"),  # two costing rows
    (9, "GX704 Greenhouse Vent Opener", "1.049,00"),  # nothing like it
    (10, "GX705 Seed Tray 24 Cells", "3.30"),  # a sibling: another number of cells, so another item
    (11, "GX706 Grand Total", "99"),  # a footer
]
COSTING = [
    (3, "watering can, zinc - 9 L", "17.90"),
    (4, "Trowel Ash Handle Wide Blade", "7.50"),
    (5, "Wall mounted hose reel 30 m", "59"),
    (6, "TWINE JUTE BALL", "2"),
    (7, "Twine (jute) ball", "2.20"),
    (8, "Seed Tray 60 Cells", "4.10"),
    (9, "Rain Barrel Oak", "120"),
]


def sheet(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA)


def compare(spark, claims, costing, **settings):
    return Comparison(sheet(spark, claims), sheet(spark, costing), Settings(**settings))


@pytest.fixture(scope="module")
def results(spark):
    c = compare(spark, CLAIMS, COSTING)
    assert c.mode == "firstToken"
    return {r["a_row"]: r for r in c.results.collect()}


def test_every_claim_has_one_status(results):
    assert len(results) == len(CLAIMS) and all(r["status"] in STATUSES for r in results.values())


def test_statuses(results):
    assert {i: (r["status"], r["method"]) for i, r in results.items()} == {
        5: ("STRONG", "exact"),
        6: ("PROBABLE", "fuzzy"),
        7: ("PROBABLE", "fuzzy"),
        8: ("STRONG", "exact"),
        9: ("UNMATCHED", None),
        10: ("UNMATCHED", None),
        11: ("UNMATCHED", None),
    }


def test_details(results):
    assert results[5]["difference"] == -0.5 and results[7]["difference"] == -5.9 and results[9]["a_price"] == 1049
    assert [c["b_row"] for c in results[8]["candidates"]] == [6, 7] and not results[9]["candidates"] and not results[11]["candidates"]
    # 11 of 14 bigrams are shared, 79; two differing numbers cost 44, so it ends below the floor.
    assert not results[10]["candidates"] and 60 <= results[6]["score"] < 100


def one(spark, claim, costing, **settings):
    return compare(spark, [claim], costing, **settings).results.first()


def test_column_code_confirms(spark):
    r = one(spark, (4, "Q-8815 Gearbox Mount Rubber", "75"), [(9, "Gearbox Mount Rubber Front", "60.50", "Q 8815")])
    assert (r["status"], r["method"], r["chosen"]["b_row"], r["difference"]) == ("CONFIRMED", "code", 9, -14.5)


def test_code_of_another_item_conflicts(spark):
    r = one(spark, (4, "71650-5T11 Cabin Lamp", "33"), [(9, "Tow Hook Chrome Plated", "21", "71650-5T11")])
    assert r["status"] == "CONFLICT" and r["chosen"] is None


def test_sibling_number_does_not_win(spark):
    r = one(spark, (4, "ZW-3 Drill Chuck 13 Keyless", "41"), [(2, "drill chuck 10 keyless", "38"), (9, "Drill Chuck 13 Keyless", "40")])
    assert r["status"] == "STRONG" and r["chosen"]["b_row"] == 9


def test_tolerance_is_no_evidence(spark):
    got = [one(spark, (4, "ZW-9 Paint Roller Foam", "20"), [(2, "paint roller foam", "27")], price_tolerance=t) for t in (0.0, 50.0)]
    assert [r["status"] for r in got] == ["STRONG", "STRONG"] and got[0]["difference"] == got[1]["difference"] == 7


def test_sizes_that_differ_are_noted(spark):
    r = one(spark, (4, "ZW-12 Seal Ring 12x30x7 KD40881", "4"), [(9, "Seal Ring 12x32x7", "5", "KD-40881")])
    assert r["status"] == "CONFIRMED" and any("dimensions differ (12x30x7 vs 12x32x7)" in n for n in r["notes"])


def test_compatibility_characters_fold(spark):
    claims, costing = sheet(spark, [(4, "ZW-1 Ｖａｌｖｅ Ｃａｐ ⅜", "4")]), sheet(spark, [(9, "valve cap 3 8", "5")])
    plain, folded = (Comparison(claims, costing, Settings(), fold=f).results.first()["status"] for f in (False, True))
    assert plain == "UNMATCHED" and folded == "STRONG"


@pytest.mark.parametrize("mode,pattern", [("none", None), ("firstToken", None), ("lastToken", None), ("regex", "^GX\\d+\\s+")])
def test_every_strip_mode(spark, mode, pattern):
    c = compare(spark, CLAIMS, COSTING, code_strip=mode, code_pattern=pattern)
    assert c.results.count() == len(CLAIMS)


def test_empty_sides(spark):
    assert compare(spark, [], []).results.count() == 0
    assert [r["status"] for r in compare(spark, CLAIMS[:1], []).results.collect()] == ["UNMATCHED"]


def test_quantity_weighted_range(spark):
    c = compare(spark, [(4, "Paint Roller Foam", "90")], [(2, "paint roller foam", "60", None, 3.0), (3, "paint roller foam", "80", None, 1.0), (5, "paint roller foam", "0", None, 6.0)], code_strip="none")
    v = c.values.first().asDict()
    assert (v["lowest"], v["highest"], v["weighted_avg"]) == (60, 80, 65)  # (3 * 60 + 80) / 4; what costs nothing doesn't count
    assert c.flagged().first()["flag"] == "above"


@pytest.mark.parametrize("bad", [{"review_floor": 100}, {"price_tolerance": 51}, {"code_strip": "middle"}, {"code_strip": "regex"}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_report_is_written(spark, tmp_path):
    compare(spark, CLAIMS, COSTING).write_report(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/full_audit").count() == len(CLAIMS)
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == len(COSTING)


def test_report_reads_back_as_it_was(spark, tmp_path):
    c = compare(spark, CLAIMS + [(12, "GX701 Trowel Ash Handle Wide", "7", None, 3.0)], COSTING)
    c.write_report(str(tmp_path))
    sheets = c.report()
    assert set(sheets) == {"summary", "price_summary", "status_money", "full_audit", "action_list", "ledger"}
    assert {"Claimed Qty", "Assessed Qty", "Duplicate Rows"} <= set(sheets["full_audit"].columns)
    for name, df in sheets.items():
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert back.columns == [x.lower().replace(" %", "_pct").replace(" ", "_") for x in df.columns]
        assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, (tuple(r) for r in df.collect()))), name
    rows = {r["A Row"]: r["Duplicate Rows"] for r in sheets["full_audit"].collect()}
    assert rows[6] == "12" and rows[12] == "6" and rows[5] == ""


def test_report_leaves_out_what_there_is_nothing_of(spark):
    sheets = compare(spark, CLAIMS, []).report()
    assert "ledger" not in sheets
    assert not {"Claimed Qty", "Assessed Qty", "Duplicate Rows"} & set(sheets["full_audit"].columns)


def test_stream_equals_batch(spark, tmp_path):
    from tallyspark.operators import matching
    from tallyspark.streaming.claims import exact_matches

    claims, costing = sheet(spark, CLAIMS), matching.prepare_costing(sheet(spark, COSTING), alt_keys=True)
    claims.write.parquet(f"{tmp_path}/in")
    stream = exact_matches(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), costing, "firstToken")
    q = stream.writeStream.format("memory").queryName("matched").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["a_id"], r["b_row"])
    assert sorted(map(key, spark.table("matched").collect())) == sorted(map(key, exact_matches(claims, costing, "firstToken").collect()))


def test_fuzzy_query_scores_every_open_claim(spark):
    from tallyspark.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    fuzzy = {r["a_cleaned"] for r in QUERIES["match_status"](spark, folder).filter("method = 'fuzzy'").collect()}
    scored = {r["a_key"] for r in QUERIES["fuzzy_topk_open"](spark, folder).select("a_key").collect()}
    assert any(name.endswith(" front left") for name in scored)
    assert fuzzy and fuzzy <= scored


def test_exact_join_links_every_row(spark):
    from tallyspark.operators import matching
    from tallyspark.streaming.claims import exact_matches

    claims, costing = sheet(spark, CLAIMS[:1]), matching.prepare_costing(sheet(spark, [(k, "watering can zinc 9 l", "1") for k in range(120)]), alt_keys=True)
    a = matching.prepare_claims(claims, "firstToken")
    assert matching.exact_hits(a, matching.description_keys(costing)).count() == 120
    assert exact_matches(claims, costing, "firstToken").count() == 120
    assert len(one(spark, CLAIMS[0], [(k, "watering can zinc 9 l", "1") for k in range(120)], code_strip="firstToken")["candidates"]) == 50
