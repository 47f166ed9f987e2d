"""Labelled rows for training: a bounded sample of the training fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import is_held_out


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, y``: one row a document of the training fold; null labels are left out,
    and of labels that contradict each other the larger holds."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    return known.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))


def draw(rows: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows, the same in every run: those whose ids hash lowest."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(size)
