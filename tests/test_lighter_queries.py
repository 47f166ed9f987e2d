"""Queries that need a part of a comparison prepare that part only, with the same results."""

import pytest
from pyspark.sql import functions as F
from test_oracle import DATA, compare

from tallyspark.functions import money, text
from tallyspark.operators import matching
from tallyspark.plans import queries


def refuse(*_, **__):
    raise AssertionError("not needed")


def test_words_are_weighed_without_preparing_rows(spark, monkeypatch):
    monkeypatch.setattr(matching, "prepare_costing", refuse)
    compare(spark, "token_idf")


def test_codes_are_counted_without_notes_and_lists(spark, monkeypatch):
    monkeypatch.setattr(matching, "hit_note", refuse)
    compare(spark, "code_counts")


def test_counts_are_those_of_the_code_stage(spark):
    c = queries._comparison(spark, str(DATA))
    columns = ("a_id", "n_strong", "n_weak", "n_conflict")
    whole = matching.code_stage(c.a, c.b)[0].select(*columns)
    assert sorted(matching.code_counts(c.a, c.b, heavy=50).collect()) == sorted(whole.collect())


def test_names_are_stripped_once(spark, monkeypatch):
    compare(spark, "strip_code_modes")
    monkeypatch.setattr(text, "strip_code", refuse)
    assert queries.QUERIES["strip_code_modes"](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("mode", [("none", None), ("firstToken", None), ("lastToken", None), ("auto", None), ("regex", "[A-Z]+-[0-9]+"), ("regex", "(")])
def test_several_modes_give_what_each_gives(spark, mode):
    names = spark.createDataFrame([(None,), ("",), (" A-1  Hose ",), ("Hose (B12)",), ("A-1",), ("12x4 Hose X-9",)], "name string")
    both = names.select(text.strip_code(F.col("name"), *mode).alias("one"), text.strip_codes(F.col("name"), {"x": mode})["x"].alias("other"))
    assert all(r["one"] == r["other"] for r in both.collect())


def test_plain_prices_are_read_as_the_others(spark):
    typed = ["0", "007", "12.50", "1.2345", "1234567.8", "99999999999999999999", "3.", ".5", "1,5", "1.2.2020", "12\n"]
    rows = spark.createDataFrame([(t,) for t in typed], "t string")
    both = rows.select(money.clean_price(F.col("t")).alias("a"), money._price_of_marked(text.js_trim(F.col("t"))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and both[2]["a"] == 12.5
