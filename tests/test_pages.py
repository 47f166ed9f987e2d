"""Pages read from ranges, against one sort."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import views


@pytest.mark.parametrize("n,ranges,size", [(500, 7, 60), (30, 16, 7), (1, 4, 3)])
def test_pages_together_are_the_sort(spark, n, ranges, size):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 1.0, 2.0, float(i)])) for i in range(n)]
    order = [F.col("d").desc_nulls_last(), F.col("a_row").asc()]
    index = views.page_index(spark.createDataFrame(rows, "a_row long, d double").repartition(5), order, ranges)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    got = [[r["a_row"] for r in index.page(k, size).collect()] for k in range(-(-n // size) + 2)]
    assert index.rows == n and [i for page in got for i in page] == want
    assert [len(page) for page in got] == [max(0, min(size, n - k * size)) for k in range(len(got))]


def test_a_late_page_reads_few_ranges(spark):
    index = views.page_index(spark.range(5000).select(F.col("id").alias("a_row")), [F.col("a_row").asc()], 20)
    page = index.page(45, 100)
    read = {f.rsplit("/_part=", 1)[1].split("/")[0] for f in (r[0] for r in index.table.select(F.input_file_name()).distinct().collect())}
    assert len(read) == 20
    plan = page._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "Exchange rangepartitioning(a_row" not in plan
    assert [r["a_row"] for r in page.collect()] == list(range(4500, 4600))


def test_empty_table(spark):
    index = views.page_index(spark.range(0).select(F.col("id").alias("a_row")), [F.col("a_row").asc()], 4)
    assert index.rows == 0 and index.page(0).count() == 0
