"""Claims of one description share one list of candidates."""

from pyspark.sql import functions as F

from tallyspark.plans.reconcile import Comparison
from tallyspark.plans.settings import STORED, Settings


def test_a_description_is_listed_once_whatever_its_claims(spark):
    claim, row = "row_num long, raw_name string, raw_price string, raw_code string, raw_qty double", "row_num long, raw_name string, raw_price string, raw_code string, raw_qty double"
    claims = [(k, "brass lamp", "5", None, 1.0) for k in range(2, 202)] + [(300, "brass lamp KX2210", "5", None, 1.0), (301, "brass lampe", "5", None, 1.0), (302, "brass lampe", "6", None, 1.0)]
    costing = [(k, "brass lamp", "4", None, 1.0) for k in range(1000, 1060)] + [(2000, "brass lamp KX2210", "3", None, 1.0)]
    c = Comparison(spark.createDataFrame(claims, claim), spark.createDataFrame(costing, row), Settings(code_strip="none"))
    shown = {r["a_id"]: r for r in c.results.withColumn("rows", F.transform("candidates", lambda x: x["b_row"])).collect()}
    assert len(shown) == len(claims)
    for k in range(2, 202):
        assert shown[k]["rows"] == list(range(1000, 1000 + STORED)) and shown[k]["status"] == "STRONG"
    assert shown[301]["status"] == "PROBABLE" and shown[301]["rows"] == shown[302]["rows"]
    assert shown[300]["candidates"][0]["matched_code"] == "KX2210"
    # Lists of "brass lamp", "brass lampe" and the coded claim; before, a row for each claim and candidate.
    assert c.stages[-1].count() == 3
