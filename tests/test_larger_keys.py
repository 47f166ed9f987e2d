"""Tables whose keys are as large as in big copies: claim codes repeat, rows have neither name nor price."""

import pytest
from pyspark.sql import functions as F
from test_oracle import DATA, compare

from tallyspark.plans.queries import QUERIES


def shifted(spark, folder, by):
    """The small parts and lines, with numbers larger by ``by``."""
    for table, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        rows = spark.read.parquet(f"{DATA}/{table}.parquet").withColumn(key, F.col(key) + by)
        rows.toPandas().to_parquet(f"{folder}/{table}.parquet", coerce_timestamps="us")
    return folder


@pytest.fixture(scope="module")
def large_keys(spark, tmp_path_factory):
    return shifted(spark, tmp_path_factory.mktemp("large-keys"), 1_000_000)


@pytest.mark.parametrize("name", ["code_join", "exact_join", "exact_stored", "reverse_search", "match_status", "report_summary", "code_mode_detect"])
def test_codes_of_claims_that_are_cut_to_five_digits(spark, large_keys, name):
    compare(spark, name, large_keys)


@pytest.mark.parametrize("name", ["file_health", "health_samples", "health_hints"])
def test_rows_with_neither_name_nor_price(spark, tmp_path, name):
    folder = shifted(spark, tmp_path, 97 * 53 - 100)  # row 97 * 53 has neither
    if name == "file_health":
        assert QUERIES[name](spark, str(folder)).first()["blank_names"] == 3
    compare(spark, name, folder)
