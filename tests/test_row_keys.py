"""Descriptions of costing rows are found by name: rows travel with their numbers alone, and what else they tell isn't written."""

import os

import pytest
from test_oracle import compare

from tallyspark.operators import matching
from tallyspark.sources import shared


@pytest.mark.parametrize("name", ["exact_join", "exact_stored", "fuzzy_topk"])
def test_no_table_of_whole_rows_is_written(spark, name):
    folder = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    compare(spark, name)
    kinds = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert "row-keys" in kinds and not kinds & {"costing", "costing-rows", "row-names"}


@pytest.mark.parametrize("alt_keys", [True, False])
def test_row_keys_equal_those_of_prepared_rows(spark, alt_keys):
    names = ["VND1 small ring 7mm", "small ring 7mm", "small ring 7mm ", None, "", "GRAND TOTAL", "VND1 small ring 7mm", "A-1 lid", "lid"]
    rows = spark.createDataFrame([(i, n, "1", None) for i, n in enumerate(names)], "row_num long, raw_name string, raw_price string, raw_code string")
    want = sorted(map(tuple, matching.description_keys(matching.prepare_costing(rows, alt_keys)).collect()))
    assert sorted(map(tuple, matching.row_keys(rows, alt_keys).collect())) == want and len(want) >= 6
    wanted = spark.createDataFrame([("small ring 7mm",), ("other",)], "key string")
    assert sorted(map(tuple, matching.row_keys(rows, alt_keys, wanted=wanted).collect())) == [x for x in want if x[0] == "small ring 7mm"]
