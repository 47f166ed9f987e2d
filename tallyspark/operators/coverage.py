"""The costing side: which rows support claims, and which none does; duplicate claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import similarity, text
from tallyspark.functions.money import ext_amount
from tallyspark.plans.settings import PAIRED
from tallyspark.sources.shared import settle


def support_links(results: DataFrame) -> DataFrame:
    """``b_row, a_row, a_raw_name, a_price``: costing rows that established claims refer to."""
    paired = results.filter(F.col("status").isin(*PAIRED))
    rows = F.array_distinct(F.concat(F.transform("candidates", lambda c: c["b_row"]), F.when(F.col("chosen").isNotNull(), F.array("chosen.b_row")).otherwise(F.array().cast("array<bigint>"))))
    return paired.select(F.explode(rows).alias("b_row"), "a_row", "a_raw_name", "a_price")


def unused_names(costing: DataFrame, results: DataFrame) -> DataFrame:
    """``b_raw_name``, each once, of costing rows that no established claim refers to.

    A name's rows are counted, and those of them that are referred to: no row travels, and none is brought to its references.
    """
    reference = lambda c: F.struct(c["b_row"].alias("b_row"), c["raw_name"].alias("b_raw_name"))
    paired = results.filter(F.col("status").isin(*PAIRED))
    rows = F.concat(F.transform("candidates", reference), F.array_compact(F.array(F.when(F.col("chosen").isNotNull(), reference(F.col("chosen"))))))
    used = paired.select(F.explode(F.array_distinct(rows)).alias("r")).select("r.*").distinct()
    used = settle(used.groupBy("b_raw_name").agg(F.count("*").alias("used")), "used-names")
    names = costing.groupBy("b_raw_name").agg(F.count("*").alias("n")).join(used, "b_raw_name", "left")
    return names.filter(F.col("n") > F.coalesce("used", F.lit(0))).select("b_raw_name")


def unmatched_costing(costing: DataFrame, results: DataFrame) -> DataFrame:
    """``b_row, name, price, qty, extended`` of costing rows that no established claim refers to."""
    used = support_links(results).select("b_row").distinct()
    left = costing.join(used, "b_row", "left_anti")
    return left.select("b_row", F.col("b_raw_name").alias("name"), F.col("b_price").alias("price"), "qty", ext_amount(F.col("qty"), F.col("b_price")).alias("extended"))


#: Claims that a line of the ledger names; of more it says how many.
NAMED_CLAIMS = 200


def supports(links: DataFrame, named: int = NAMED_CLAIMS) -> DataFrame:
    """``b_row, n_claims, first_a_row, ref_a_price, s``: each line's claims by row, the first ``named`` of them in ``s``.

    ``ref_a_price`` is that of the first claim that has one.  Counts and firsts combine before they
    shuffle, so a line that very many claims refer to is never one list.
    """
    priced = F.min(F.when(F.col("a_price").isNotNull(), F.struct("a_row", "a_price")))
    counts = links.groupBy("b_row").agg(F.count("*").alias("n_claims"), F.min("a_row").alias("first_a_row"), priced["a_price"].alias("ref_a_price"))
    place = F.row_number().over(Window.partitionBy("b_row").orderBy("a_row"))
    firsts = links.withColumn("place", place).filter(F.col("place") <= named)
    lists = firsts.groupBy("b_row").agg(F.array_sort(F.collect_list(F.struct("a_row", "a_raw_name"))).alias("s"))
    return counts.join(lists, "b_row")


def ledger(costing: DataFrame, results: DataFrame, claim_qty: DataFrame | None = None, named: int = NAMED_CLAIMS) -> DataFrame:
    """Every costing row with the claims it supports, or ``Unmatched``.

    ``claim_qty`` has ``a_row, qty``; the claimed quantity is that of the first claim.  Of the claims the
    first ``named`` are written out, then how many more there are.
    """
    supported = supports(support_links(results), named)
    if claim_qty is not None:
        supported = supported.join(claim_qty.select(F.col("a_row").alias("first_a_row"), F.col("qty").alias("claimed_qty")), "first_a_row", "left")
    else:
        supported = supported.withColumn("claimed_qty", F.lit(None).cast("double"))
    # Complete before it meets the costing rows: these are many and wide, and travel once.
    df = costing.join(settle(supported, "ledger-claims"), "b_row", "left")
    rows = F.transform("s", lambda x: x["a_row"].cast("string"))
    more = F.when(F.col("n_claims") > named, F.concat(F.lit(" and "), (F.col("n_claims") - named).cast("string"), F.lit(" more"))).otherwise("")
    gap = F.when(F.col("ref_a_price") != 0, F.abs(F.col("b_price") - F.col("ref_a_price")) / F.col("ref_a_price") * 100)
    return df.select(
        "b_row",
        F.col("b_raw_name").alias("description"),
        F.coalesce("b_code", F.lit("")).alias("part_code"),
        "claimed_qty",
        F.col("qty").alias("assessed_qty"),
        F.col("b_price").alias("unit_price"),
        F.coalesce(ext_amount(F.col("qty"), F.col("b_price")), F.col("b_price")).alias("total_cost"),
        F.when(F.col("s").isNull(), "Unmatched").otherwise(F.concat(F.lit("Paired → A"), F.array_join(rows, ", A"), more)).alias("status"),
        F.coalesce(F.concat(F.array_join(rows, ", "), more), F.lit("")).alias("claim_rows"),
        F.coalesce(F.concat(F.array_join(F.transform("s", lambda x: x["a_raw_name"]), " | "), more), F.lit("")).alias("claim_items"),
        F.col("s").isNotNull().alias("matched"),
        "ref_a_price",
        gap.alias("diff_pct"),
    )


def duplicate_claims(claims: DataFrame) -> DataFrame:
    """``a_row, others``: claims whose whole description (code included) stands on other rows too.

    ``claims`` has ``row_num, raw_name``.  A description on very many rows gives each of them a
    list of all others, as asked; :func:`duplicate_members` is the form that grows linearly.
    """
    groups = duplicate_groups(claims)
    each = groups.select(F.explode("rows").alias("a_row"), "rows")
    return each.select("a_row", F.filter("rows", lambda x: x != F.col("a_row")).alias("others"))


#: Other rows of its description that a claim names; of more it says how many.
NAMED_ROWS = 50


def duplicate_lists(claims: DataFrame, named: int = NAMED_ROWS) -> DataFrame:
    """``a_row, others, more``: the first ``named`` other rows of a claim's description, and how many more there are."""
    members = settle(duplicate_members(claims), "duplicate-members")
    firsts = members.filter(F.col("place") <= named + 1).groupBy("cleaned").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    others = F.slice(F.filter("rows", lambda x: x != F.col("row")), 1, named)
    listed = members.join(firsts.hint("merge"), "cleaned").select(F.col("row").alias("a_row"), others.alias("others"), "n")
    return listed.select("a_row", "others", (F.col("n") - 1 - F.size("others")).alias("more"))


def duplicate_groups(claims: DataFrame) -> DataFrame:
    """``cleaned, rows``: descriptions on more than one row."""
    cleaned = claims.select(F.col("row_num").cast("long").alias("row"), text.normalize_description(F.col("raw_name")).alias("cleaned")).filter("cleaned <> ''")
    groups = cleaned.groupBy("cleaned").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return groups.filter(F.size("rows") > 1)


def duplicate_members(claims: DataFrame, tasks: int | None = None) -> DataFrame:
    """``cleaned, row, place, n``: each row of a description that stands on several, its place among them and their number.

    No group is brought together: rows are dealt to ranges of (description, row), counted by range,
    and placed by how many of their description stand in the ranges before.
    """
    rows = claims.select(F.col("row_num").cast("long").alias("row"), text.normalize_description(F.col("raw_name")).alias("cleaned")).filter("cleaned <> ''")
    spread = tasks or claims.sparkSession.sparkContext.defaultParallelism
    ranged = settle(rows.repartitionByRange(spread, "cleaned", "row").withColumn("part", F.spark_partition_id()), "ranged-names")
    counts = ranged.groupBy("cleaned", "part").agg(F.count("*").alias("here"))
    of_name = Window.partitionBy("cleaned")  # a row a range, not a row a claim
    before = F.coalesce(F.sum("here").over(of_name.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("cleaned", "part", before.alias("before"), F.sum("here").over(of_name).alias("n")).filter("n > 1")
    place = F.row_number().over(Window.partitionBy("part", "cleaned").orderBy("row"))
    placed = ranged.withColumn("here", place).join(counts, ["cleaned", "part"])
    return placed.select("cleaned", "row", (F.col("before") + F.col("here")).alias("place"), "n")


def coverage_counts(costing: DataFrame, results: DataFrame) -> DataFrame:
    """One row: ``total, paired, unmatched`` costing rows."""
    used = support_links(results).select("b_row").distinct().withColumn("used", F.lit(1))
    joined = costing.select("b_row").join(used, "b_row", "left")
    return joined.agg(F.count("*").alias("total"), F.count("used").alias("paired"), (F.count("*") - F.count("used")).alias("unmatched"))


def reverse_search(results: DataFrame, description: str, most: int = 8) -> DataFrame:
    """The claims most like one costing description: the better of both directions, less the
    penalty for differing numbers once more."""
    b = text.normalize_description(F.lit(description))
    a = F.col("a_cleaned")
    best = F.greatest(similarity.similarity(a, b), similarity.similarity(b, a)) - similarity.sibling_penalty(a, b)
    scored = results.select("a_id", "a_row", "a_raw_name", F.greatest(F.lit(0), best).alias("sim"))
    return scored.orderBy(F.desc("sim"), "a_id").limit(most)
