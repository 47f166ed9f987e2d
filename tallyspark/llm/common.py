"""What the training-data operators share: tables, words, the fold, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.shared import settle, shared_dir

__all__ = ["BATCH_BYTES", "WORD_PATTERN", "is_held_out", "settle", "shared_dir", "small_batches", "table", "word_count"]

#: ASCII white space, the only word separators of these operators.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of one Arrow batch, so that a batch of very long texts stays small.
BATCH_BYTES = "16m"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, because texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """Fold 2 of 4 by the id's CRC32; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
