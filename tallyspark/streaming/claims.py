"""Claims that arrive as a stream against a costing table at rest.

Codes and whole descriptions are equi-joins, which need no state; the fuzzy stage looks at
all descriptions and stays with batches (use ``foreachBatch`` with a Comparison).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import matching


def exact_matches(claims: DataFrame, costing: DataFrame, mode: str = "none") -> DataFrame:
    """``a_id, b_row, matched_by`` of a streaming ``claims`` and a prepared ``costing``
    (:func:`tallyspark.operators.matching.prepare_costing`): by column code, else by description."""
    a = matching.prepare_claims(claims, mode).filter("gate is null").select("a_id", "a_cleaned", "own_code")
    codes = costing.filter("own_code is not null").select("b_row", F.col("own_code").alias("key"), F.lit("code").alias("matched_by"))
    names = matching.description_keys(costing).select("b_row", "key", F.lit("exact").alias("matched_by"))
    wanted = a.select("a_id", F.explode(F.array(F.struct(F.col("own_code").alias("key"), F.lit("code").alias("by")), F.struct(F.col("a_cleaned").alias("key"), F.lit("exact").alias("by")))).alias("w"))
    keys = codes.unionByName(names)
    return wanted.join(keys, (F.col("w.key") == F.col("key")) & (F.col("w.by") == F.col("matched_by"))).select("a_id", "b_row", "matched_by")
