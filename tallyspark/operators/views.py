"""Filtering, sorting and paging of results and of the ledger."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import gap_percent
from tallyspark.plans.settings import PAIRED, REVIEW_ORDER
from tallyspark.sources.shared import shared_dir

#: Difference in percent up to which a paired row agrees.
AGREES_TO = 5.0
SORT_KEYS = ("row", "name", "aPrice", "bPrice", "diff", "score", "status")


def filter_results(
    results: DataFrame, query: str = "", status: str | None = None, problems_only: bool = False, gap_pct: float | None = None, gap_mode: str = "beyond"
) -> DataFrame:
    """Rows by status, by a part of either name, and by gap within or beyond a tolerance."""
    df = results
    if problems_only:
        df = df.filter(~F.col("status").isin(*PAIRED))
    if status is not None:
        df = df.filter(F.col("status") == status)
    if query.strip():
        wanted = query.strip().lower()
        df = df.filter(F.lower("a_raw_name").contains(wanted) | F.coalesce(F.lower("chosen.raw_name"), F.lit("")).contains(wanted))
    if gap_pct is not None and gap_pct >= 0:
        gap = gap_percent(F.col("difference"), F.col("a_price"))
        df = df.filter(gap <= gap_pct if gap_mode == "within" else gap > gap_pct)
    return df


def sort_results(results: DataFrame, key: str = "row", ascending: bool = True) -> DataFrame:
    """By one of ``SORT_KEYS``; a missing number is less than any; ties by row."""
    return results.orderBy(*sort_order(key, ascending))


def sort_order(key: str = "row", ascending: bool = True) -> list[Column]:
    """The columns that :func:`sort_results` sorts by."""
    if key not in SORT_KEYS:
        raise ValueError(f"key must be one of {', '.join(SORT_KEYS)}")
    rank = F.array_position(F.array(*[F.lit(s) for s in REVIEW_ORDER]), F.col("status"))
    column = {"row": F.col("a_row"), "name": F.lower("a_raw_name"), "aPrice": F.col("a_price"), "bPrice": F.col("b_price"), "diff": F.col("difference"), "score": F.col("score"), "status": rank}[key]
    return [column.asc_nulls_first() if ascending else column.desc_nulls_last(), F.col("a_row").asc()]


@dataclass(frozen=True)
class PageIndex:
    """A table sorted once: ranges in folders of their own, and how many rows stand before each.

    A page reads the ranges that hold it, whether it is the first or the last one.
    """

    table: DataFrame
    starts: tuple[int, ...]

    @property
    def rows(self) -> int:
        return self.starts[-1]

    def page(self, number: int, size: int = 100) -> DataFrame:
        """The rows of one page, counted from 0, in their order."""
        first, last = number * size, min((number + 1) * size, self.rows)
        parts = [k for k, (a, b) in enumerate(zip(self.starts, self.starts[1:])) if a < last and b > first]
        if not parts:
            return self.table.filter("false").drop("_part", "_at")
        start = F.element_at(F.array(*[F.lit(self.starts[k]).cast("long") for k in parts]), (F.col("_part") - parts[0] + 1).cast("int"))
        held = self.table.filter(F.col("_part").between(parts[0], parts[-1])).withColumn("_at", start + F.col("_at"))
        return held.filter((F.col("_at") >= first) & (F.col("_at") < last)).orderBy("_at").drop("_part", "_at")


def page_index(rows: DataFrame, order: list[Column], ranges: int | None = None) -> PageIndex:
    """Sort ``rows`` by ``order`` (which should end in a key) into ranges, once for all pages."""
    spark = rows.sparkSession
    n = ranges or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Numbers of a range's rows in their order: the low bits of the running id.
    numbered = sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = f"{shared_dir(spark)}/page-index-{uuid.uuid4().hex}"
    numbered.write.partitionBy("_part").option("compression", "zstd").parquet(path)
    table = spark.read.schema(numbered.schema).parquet(path)
    counts = {r["_part"]: r["n"] for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a range
    starts = [0]
    for k in range(n):
        starts.append(starts[-1] + counts.get(k, 0))
    return PageIndex(table, tuple(starts))


def page(sorted_rows: DataFrame, number: int, size: int = 100) -> DataFrame:
    """The rows of one page, counted from 0."""
    return sorted_rows.offset(number * size).limit(size)


def filter_ledger(ledger: DataFrame, query: str = "", show: str = "all") -> DataFrame:
    """``show``: all, paired-agreed, paired-differs or unmatched; ``query``: part of name or code."""
    df = ledger
    agrees = F.coalesce(F.col("diff_pct") <= AGREES_TO, F.lit(False))
    if show == "paired-agreed":
        df = df.filter(F.col("matched") & agrees)
    elif show == "paired-differs":
        df = df.filter(F.col("matched") & ~agrees)
    elif show == "unmatched":
        df = df.filter(~F.col("matched"))
    if query.strip():
        wanted = query.strip().lower()
        df = df.filter(F.lower("description").contains(wanted) | F.lower("part_code").contains(wanted))
    return df


def sort_ledger(ledger: DataFrame) -> DataFrame:
    """Unmatched rows first, then by row."""
    return ledger.orderBy("matched", "b_row")
