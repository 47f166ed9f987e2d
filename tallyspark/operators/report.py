"""The report's tables: audit, action list, price summary, and what the screens show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import ext_amount, gap_percent, mean, round2, round_half_up, total
from tallyspark.operators.valuation import flagged
from tallyspark.plans.settings import PAIRED, STATUSES, Settings

# How statuses are written in reports.
STATUS_NAMES = {"CONFIRMED": "Confirmed", "STRONG": "Strong", "PROBABLE": "Probable", "CONFLICT": "Conflict", "UNMATCHED": "Unmatched"}

# The audit's columns.
AUDIT_COLUMNS = (
    "A Row", "A Item Name", "A Cleaned Name", "A Part Codes", "A Price", "B Row", "B Matched Name", "B Cleaned Name",
    "B Price", "Records", "Lowest", "Highest", "Wtd Avg", "Difference", "Gap %", "Score", "Method", "Status",
)
QTY_COLUMNS = ("Claimed Qty", "Assessed Qty")


def audit(
    results: DataFrame,
    values: DataFrame,
    claim_qty: DataFrame | None = None,
    costing_qty: DataFrame | None = None,
    duplicates: DataFrame | None = None,
    screened: bool = False,
) -> DataFrame:
    """Every claim with its reference, range and notes; optional columns only where there is data.

    ``claim_qty`` has ``a_row, qty``; ``costing_qty`` ``b_row, qty``; ``duplicates`` ``a_row, others, more``.
    """
    df = results.join(values, "a_id", "left")
    if claim_qty is not None or costing_qty is not None:
        none = F.lit(None).cast("double")
        df = df.join(claim_qty.select("a_row", F.col("qty").alias("Claimed Qty")), "a_row", "left") if claim_qty is not None else df.withColumn("Claimed Qty", none)
        if costing_qty is not None:
            assessed = costing_qty.select(F.col("b_row").alias("ref_row"), F.col("qty").alias("Assessed Qty"))
            df = df.withColumn("ref_row", F.col("chosen.b_row")).join(assessed, "ref_row", "left")
        else:
            df = df.withColumn("Assessed Qty", none)
    if duplicates is not None:
        further = F.when(F.col("more") > 0, F.concat(F.lit(" and "), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
        listed = F.concat(F.array_join(F.transform("others", lambda x: x.cast("string")), ", "), further)
        # Lists of rows are far larger than the tables they are made from, by whose size Spark would choose to broadcast them.
        df = df.join(duplicates.select("a_row", listed.alias("dups")).hint("merge"), "a_row", "left")
    named = {
        "A Row": F.col("a_row"),
        "A Item Name": F.col("a_raw_name"),
        "A Cleaned Name": F.col("a_cleaned"),
        "A Part Codes": F.array_join("a_codes", ", "),
        "A Price": F.col("a_price"),
        "B Row": F.col("chosen.b_row"),
        "B Matched Name": F.coalesce(F.col("chosen.raw_name"), F.lit("")),
        "B Cleaned Name": F.coalesce(F.col("chosen.cleaned"), F.lit("")),
        "B Price": F.col("b_price"),
        "Records": F.col("count"),
        "Lowest": F.col("lowest"),
        "Highest": F.col("highest"),
        "Wtd Avg": F.col("weighted_avg"),
        "Difference": F.col("difference"),
        "Gap %": gap_percent(F.col("difference"), F.col("a_price")),
        "Score": F.col("score"),
        "Method": F.coalesce("method", F.lit("")),
        "Status": status_name(F.col("status")),
    }
    columns = [named[c].alias(c) for c in AUDIT_COLUMNS]
    if "Claimed Qty" in df.columns:
        columns[8:8] = [F.col(c) for c in QTY_COLUMNS]
    if duplicates is not None:
        columns.append(F.coalesce("dups", F.lit("")).alias("Duplicate Rows"))
    if screened:
        columns.append(screening_cell(F.col("jev_verdict"), F.col("jev_confidence")).alias("Jev Verdict"))
    return df.select(*columns, F.array_join("notes", " | ").alias("Notes"))


def status_name(status: Column) -> Column:
    out = F.when(F.lit(False), "")
    for key, name in STATUS_NAMES.items():
        out = out.when(status == key, name)
    return out


def action_list(results: DataFrame) -> DataFrame:
    """Claims whose identity isn't established."""
    return results.filter(~F.col("status").isin(*PAIRED))


def screening_cell(verdict: Column, confidence: Column) -> Column:
    """``MATCH · 93%``; a confidence of at most 1 is a share."""
    percent = F.least(F.lit(100.0), round_half_up(F.when(confidence <= 1, confidence * 100).otherwise(confidence)))
    return F.when(verdict.isNull(), "").when(confidence.isNull(), verdict).otherwise(F.concat(verdict, F.lit(" · "), percent.cast("long").cast("string"), F.lit("%")))


def price_summary(results: DataFrame, values: DataFrame, depreciation_pct: float = 0.0) -> DataFrame:
    """One row of totals, gaps and flag counts; sums are null where nothing was summed."""
    df = flagged(results, values, depreciation_pct)
    gap = gap_percent(F.col("difference"), F.col("a_price"))
    above = F.col("flag") == "above"
    over = total(F.when(above, F.col("a_price") - F.col("highest")))
    a, b = total(F.col("a_price")), total(F.col("b_price"))
    net = F.when(a.isNotNull() | b.isNotNull(), F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0)))
    return df.agg(
        a.alias("total_a"),
        b.alias("total_b"),
        net.alias("net_difference"),
        total(F.abs("difference")).alias("total_abs_difference"),
        mean(gap).alias("avg_gap_pct"),
        F.max(gap).alias("max_gap_pct"),
        F.count_if(F.col("flag") == "in-range").alias("in_range"),
        F.count_if(above).alias("above"),
        round2(over).alias("above_amount"),
        F.count_if(F.col("flag") == "above-allowed").alias("above_allowed"),
        F.count_if(F.col("flag") == "below").alias("below"),
        F.count_if(F.col("flag") == "unpriced").alias("unpriced"),
    )


def status_money(results: DataFrame) -> DataFrame:
    """``status, items, sum_a, sum_b, sum_diff`` for all five statuses."""
    every = results.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in STATUSES])).alias("status"))
    seen = results.groupBy("status").agg(F.count("*").alias("n"), total(F.col("a_price")).alias("sum_a"), total(F.col("b_price")).alias("sum_b"), total(F.col("difference")).alias("sum_diff"))
    return every.join(F.broadcast(seen), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("items"), "sum_a", "sum_b", "sum_diff")


def screen_summary(results: DataFrame, values: DataFrame, depreciation_pct: float = 0.0) -> DataFrame:
    """As the summary screen counts: differences of rows priced on both sides, a claimed price of
    0 divides as 1, and the share in range is 100 where no row is priced."""
    df = flagged(results, values, depreciation_pct)
    both = F.col("a_price").isNotNull() & F.col("b_price").isNotNull()
    diff = F.when(both, F.coalesce("difference", F.lit(0.0)))
    base = F.when(F.col("a_price") == 0, 1.0).otherwise(F.col("a_price"))
    priced = F.count_if(F.col("flag") != "unpriced")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(
        F.count("a_price").alias("rows_with_a"),
        zero(total(F.col("a_price"))).alias("total_a"),
        F.count_if(both).alias("rows_with_both"),
        zero(total(diff)).alias("net_diff"),
        zero(total(F.abs(diff))).alias("abs_diff"),
        zero(mean(F.abs(diff) / base * 100)).alias("avg_abs_diff_pct"),
        F.count_if(diff > 0).alias("higher"),
        zero(total(F.when(diff > 0, diff))).alias("higher_amount"),
        F.count_if(diff < 0).alias("lower"),
        zero(total(F.when(diff < 0, -diff))).alias("lower_amount"),
        F.count_if(diff == 0).alias("equal"),
        F.when(priced > 0, F.count_if(F.col("flag") == "in-range") / priced * 100).otherwise(100.0).alias("in_range_pct"),
    )


def with_quantities(results: DataFrame, claim_qty: DataFrame, costing_qty: DataFrame) -> DataFrame:
    """Results with a reference row, and both quantities ``aq``, ``bq``."""
    df = results.filter(F.col("chosen").isNotNull()).withColumn("ref_row", F.col("chosen.b_row"))
    df = df.join(claim_qty.select("a_row", F.col("qty").alias("aq")), "a_row", "left")
    return df.join(costing_qty.select(F.col("b_row").alias("ref_row"), F.col("qty").alias("bq")), "ref_row", "left")


def quantity_check(results: DataFrame, claim_qty: DataFrame, costing_qty: DataFrame) -> DataFrame:
    """One row: ``rows, claimed_units, verified_units, mismatches`` where either side has a quantity."""
    df = with_quantities(results, claim_qty, costing_qty).filter("aq is not null or bq is not null")
    zero = F.lit(0.0)
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(total(F.col("aq")), zero).alias("claimed_units"),
        F.coalesce(total(F.col("bq")), zero).alias("verified_units"),
        F.count_if(~F.col("aq").eqNullSafe(F.col("bq"))).alias("mismatches"),
    )


def extended_amounts(results: DataFrame, claim_qty: DataFrame, costing_qty: DataFrame) -> DataFrame:
    """One row: ``claimed, verified``; the verified side uses the claimed quantity where it has none."""
    df = with_quantities(results, claim_qty, costing_qty)
    return df.agg(total(ext_amount(F.col("aq"), F.col("a_price"))).alias("claimed"), total(ext_amount(F.coalesce("bq", "aq"), F.col("b_price"))).alias("verified"))


def duplicate_value(results: DataFrame, duplicate_rows: DataFrame) -> DataFrame:
    """One row, ``rows, value``: claims whose description stands on several rows."""
    df = results.join(duplicate_rows.select("a_row").distinct(), "a_row", "left_semi")
    return df.agg(F.count("*").alias("rows"), F.coalesce(total(F.col("a_price")), F.lit(0.0)).alias("value"))


def inventory_variance(results: DataFrame, costing: DataFrame, claim_qty: DataFrame) -> DataFrame:
    """One row, ``claimed, adjuster, variance``: total cost of both sides; a line without a
    quantity counts its price, one without a price nothing."""
    zero = F.lit(0.0)
    a = results.join(claim_qty.select("a_row", F.col("qty").alias("aq")), "a_row", "left")
    claimed = a.agg(F.coalesce(total(F.coalesce(ext_amount(F.col("aq"), F.col("a_price")), F.col("a_price"))), zero).alias("claimed"))
    adjuster = costing.agg(F.coalesce(total(F.coalesce(ext_amount(F.col("qty"), F.col("b_price")), F.col("b_price"))), zero).alias("adjuster"))
    return claimed.join(F.broadcast(adjuster)).select("claimed", "adjuster", (F.col("adjuster") - F.col("claimed")).alias("variance"))


def unmatched_value(unmatched: DataFrame) -> DataFrame:
    """One row, ``rows, value``, of :func:`tallyspark.operators.coverage.unmatched_costing`."""
    return unmatched.agg(F.count("*").alias("rows"), F.coalesce(total(F.coalesce("extended", "price")), F.lit(0.0)).alias("value"))


def summary(results: DataFrame, settings: Settings, mode: str) -> DataFrame:
    """``key, value`` lines that head the report."""
    stripping = f"auto → {mode}" if settings.code_strip == "auto" else f"regex: {settings.code_pattern}" if settings.code_strip == "regex" else settings.code_strip
    counts = results.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    labels = ("Confirmed matches", "Strong matches", "Probable matches", "Conflicts", "Unmatched")
    lines = [("File A items", F.col("total").cast("string")), *[(label, F.col(s).cast("string")) for label, s in zip(labels, STATUSES)]]
    lines += [
        ("Review floor (fuzzy kept as Probable)", F.lit(str(settings.review_floor))),
        ("Reference gap tolerance (%)", F.lit(f"{settings.price_tolerance:g}")),
        ("Code stripping (name comparison only)", F.lit(stripping)),
    ]
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in lines])).alias("x")).select("x.*")
