"""What the costing evidence says about a claim's price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import cents_of_quotient, micro, round2, total
from tallyspark.sources.shared import settle


def linked_records(results: DataFrame, qty: DataFrame) -> DataFrame:
    """``a_id, b_row, name, price, qty, code``: every candidate of every claim.

    ``qty`` has ``b_row, qty``.
    """
    linked = results.select("a_id", F.explode("candidates").alias("c"))
    linked = linked.select("a_id", F.col("c.b_row").alias("b_row"), F.col("c.raw_name").alias("name"), F.col("c.price").alias("price"), F.col("c.matched_code").alias("code"))
    return linked.join(qty.select("b_row", "qty"), "b_row", "left")


def valuation(results: DataFrame, qty: DataFrame) -> DataFrame:
    """``a_id, count, zero_count, lowest, highest, weighted_avg`` of claims that have candidates.

    Records without a positive price are counted apart.  The average is weighted by quantity
    over records that have one, and plain where none has; it is a quotient of whole numbers
    (millionths), so neither partitions nor the order of the records show in a half cent.
    """
    # Written between the two shuffles, so that they don't lie on disk together, and sent as rows: a claim's sums are wider.
    records = settle(linked_records(results, qty).select("a_id", "price", "qty"), "linked-records").repartition("a_id")
    priced = F.col("price") > 0
    price = F.when(priced, F.col("price"))
    weight = F.when(priced & (F.col("qty") > 0), F.col("qty"))
    grouped = records.groupBy("a_id").agg(
        F.count_if(priced).alias("count"),
        F.count("*").alias("n"),
        F.min(price).alias("lowest"),
        F.max(price).alias("highest"),
        F.sum(micro(F.col("price")) * micro(weight)).alias("value"),
        F.sum(micro(weight)).alias("units"),
        F.sum(micro(price)).alias("prices"),
    )
    average = F.when(F.col("units") > 0, cents_of_quotient(F.col("value"), F.col("units")))
    average = average.when(F.col("count") > 0, cents_of_quotient(F.col("prices"), F.col("count")))
    return grouped.select("a_id", "count", (F.col("n") - F.col("count")).alias("zero_count"), "lowest", "highest", average.alias("weighted_avg"))


def flag(a_price: Column, depreciation_pct: float = 0.0) -> Column:
    """Where the claimed price lies; needs the columns of :func:`valuation` beside it.

    ``above-allowed``: above the range by no more than the depreciation allowance explains.
    """
    over = (a_price - F.col("highest")) / a_price * 100
    allowed = (F.lit(float(depreciation_pct)) > 0) & (over <= depreciation_pct)
    return (
        F.when(F.coalesce(F.col("count"), F.lit(0)) == 0, "unpriced")
        .when(a_price.isNull(), "unpriced")
        .when(a_price > F.col("highest"), F.when(allowed, "above-allowed").otherwise("above"))
        .when(a_price < F.col("lowest"), "below")
        .otherwise("in-range")
    )


def flagged(results: DataFrame, values: DataFrame, depreciation_pct: float = 0.0) -> DataFrame:
    """Results with the valuation's columns and ``flag``."""
    joined = results.join(values, "a_id", "left")
    return joined.withColumn("flag", flag(F.col("a_price"), depreciation_pct))


def exposure(results: DataFrame, values: DataFrame, depreciation_pct: float = 0.0) -> DataFrame:
    """One row, ``count, amount``: claims above the whole range, and by how much in sum."""
    above = flagged(results, values, depreciation_pct).filter("flag = 'above'")
    amount = F.coalesce(total(F.col("a_price") - F.col("highest")), F.lit(0.0))
    return above.agg(F.count("*").alias("count"), round2(amount).alias("amount"))
