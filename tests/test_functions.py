"""Scalar functions on literals whose results are known."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import identity, money, similarity, text


def values(spark, inputs, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_price(spark):
    cases = {"7.25": 7.25, "₱3,071.80": 3071.8, "PHP 6,040": 6040.0, "8 310,00": 8310.0, "(19.00)": -19.0, "4.018,70": 4018.7, "TBC": None, "": None, "3/4": None, "62-": -62.0, "0": 0.0}
    assert values(spark, list(cases), money.clean_price) == list(cases.values())


def test_rounding_is_half_up(spark):
    assert values(spark, [1.005, -2.5, 2.675, None], money.round2, "double") == [1.0, -2.5, 2.68, None]


def test_normalize_description(spark):
    cases = {"WOOD SCREW M5 X 35": "wood screw m5x35", "Shim 8 x 14 x 2": "shim 8x14x2", "Lamp 8 14 2": "lamp 8x14x2", "Strip 3 x 4 x 5 x 6 x 7": "strip 3x4x5x6 x 7", "4 x 5 and 6x 7": "4x5 and 6x7", "Door Seal RR RH": "door seal rear right", "  Tapón  ": "tap n", None: ""}
    assert values(spark, list(cases), text.normalize_description) == list(cases.values())


def test_part_code(spark):
    cases = {"q-8815": "Q8815", "abc": None, "12": None, "WD 40X9": "WD40X9", None: None}
    assert values(spark, list(cases), identity.part_code) == list(cases.values())


def test_codes_and_dimensions_in_text(spark):
    assert values(spark, ["CABIN LIGHT 71650-5T11 QRM-8804"], identity.codes_in_text) == [["716505T11", "QRM8804"]]
    assert values(spark, ["ring 12 x 30 x 7", "ring 12-30-7", "plain"], identity.dimensions) == [["12x30x7"], ["12x30x7"], []]


@pytest.mark.parametrize(
    "a,b,least,most",
    [
        ("drill chuck 10 keyless", "drill chuck 13 keyless", 0, 89),
        ("drill chuck 13 keyless", "drill chuck 13 keyless", 100, 100),
        ("hose reel wall", "hose reel wall mounted", 60, 100),
        ("a", "a", 100, 100),
        ("a", "ab", 0, 0),
        ("", "twine", 0, 0),
    ],
)
def test_similarity(spark, a, b, least, most):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(similarity.similarity(F.col("a"), F.col("b")).alias("s"), similarity.engine_score(F.col("a"), F.col("b")).alias("e")).first()
    assert least <= row["s"] <= most and row["s"] == row["e"]


def test_similarity_may_pass_100_before_the_penalty(spark):
    assert spark.createDataFrame([("aa", "aaaa")], "a string, b string").select(similarity.dice(F.col("a"), F.col("b")).alias("s")).first()["s"] == 150


def test_strip_code(spark):
    assert values(spark, ["GX700 HOSE REEL", "HOSE"], lambda c: text.strip_code(c, "firstToken")) == ["HOSE REEL", "HOSE"]
    assert values(spark, ["KG-12 HOSE REEL", "REEL"], lambda c: text.strip_code(c, "regex", "^KG-\\d+\\s+")) == ["HOSE REEL", "REEL"]
    assert values(spark, ["HOSE REEL 9"], lambda c: text.strip_code(c, "regex", "([")) == ["HOSE REEL 9"]


def test_document_texts_are_normalised_whole(spark, tmp_path):
    from tallyspark.plans.queries import QUERIES

    long = "Hi Lux 10 X 20! " * 8000
    rows = [(1, long), (2, None), (3, ""), (4, " 中文\tRR\n "), (None, "FRT LH"), (1, "FRT LH")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["normalize_documents"](spark, str(tmp_path)).collect()]
    want = [(1, ("hilux 10x20 " * 8000).strip()), (2, ""), (3, ""), (4, "rear"), (None, "front left"), (1, "front left")]
    assert sorted(got, key=str) == sorted(want, key=str)
