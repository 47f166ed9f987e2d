"""A health check of one sheet before it is compared: one aggregation over its cells."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import money, text
from tallyspark.operators.matching import detect_strip_mode
from tallyspark.plans.sentences import HINTS

# How many samples are shown, and which whole numbers look like date serials.
SAMPLES, DUPLICATE_ROWS = 5, 3
DATE_FROM, DATE_TO, DATE_CELLS = 20_000, 60_000, 3
DATE_SHARE, READABLE_PCT = 0.5, 80.0


def checked_rows(rows: DataFrame) -> DataFrame:
    """``row_num, name, price_kind, price_text, price_number, other`` -> flags of each row.

    ``price_kind`` is num, str, bool or null; ``other`` is the first cell of the row that isn't
    blank, or null.
    """
    named = ~text.is_blank(F.col("name"))
    blank_price = (F.col("price_kind") == "null") | ((F.col("price_kind") == "str") & text.is_blank(F.col("price_text")))
    price = F.when(F.col("price_kind") == "num", money.clean_number(F.col("price_number"))).when(F.col("price_kind") == "str", money.clean_price(F.col("price_text")))
    number = F.col("price_number")
    serial = (F.col("price_kind") == "num") & (number == F.floor(number)) & number.between(DATE_FROM, DATE_TO)
    shown = F.when(F.col("price_kind") == "num", number.cast("string")).otherwise(F.col("price_text"))
    priced = named & ~blank_price
    df = rows.withColumn("price", price)
    return df.select(
        "row_num",
        "name",
        "price",
        shown.alias("shown"),
        "other",
        named.alias("named"),
        (~named & F.col("other").isNotNull()).alias("blank_names"),
        (named & blank_price).alias("missing"),
        (priced & F.col("price").isNull()).alias("unreadable"),
        (priced & F.col("price").isNotNull()).alias("readable"),
        (priced & (F.col("price") == 0)).alias("zero"),
        (priced & (F.col("price") < 0)).alias("negative"),
        (priced & serial).alias("date_like"),
        (priced & (F.col("price_kind") == "str") & F.col("price").isNotNull()).alias("text_price"),
    )


def _count(flag: str) -> Column:
    return F.count_if(F.coalesce(F.col(flag), F.lit(False)))


def file_health(rows: DataFrame) -> DataFrame:
    """One row: the counts of :func:`checked_rows`, duplicates, readable percentage and verdict."""
    checked = checked_rows(rows)
    counts = checked.agg(
        _count("named").alias("rows"),
        *[_count(c).alias(c) for c in ("blank_names", "missing", "unreadable", "readable", "zero", "negative", "text_price")],
        _count("date_like").alias("date_cells"),
    )
    dups = duplicate_names(rows).agg(F.count("*").alias("duplicates"))
    df = counts.join(F.broadcast(dups)).withColumn("date_like", F.when(F.col("date_cells") >= DATE_CELLS, F.col("date_cells")).otherwise(0))
    share = money.round_half_up(F.col("readable") / F.greatest(F.col("rows"), F.lit(1)) * 1000) / 10
    df = df.withColumn("readable_pct", F.when(F.col("rows") > 0, share).otherwise(0.0))
    issues = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in HINTS), F.lit(0))
    mostly_dates = (F.col("date_like") > 0) & (F.col("date_like") / F.greatest(F.col("readable"), F.lit(1)) > DATE_SHARE)
    verdict = F.when((F.col("rows") == 0) | (F.col("readable_pct") < READABLE_PCT) | mostly_dates, "problems").when(F.col("issues") > 0, "warnings").otherwise("looks good")
    df = df.withColumn("issues", issues).withColumn("verdict", verdict)
    hints = F.array_compact(F.array(*[F.when(F.col(c) > 0, hint) for c, hint in HINTS.items()]))
    return df.select(
        "rows", "blank_names", "duplicates", "readable", "readable_pct", "unreadable", "missing", "zero", "negative", "date_like", "text_price", "issues", "verdict", hints.alias("hints")
    )


def duplicate_names(rows: DataFrame) -> DataFrame:
    """``key, n, name, first_rows`` of names (by the preflight key) on more than one row."""
    keyed = rows.filter(~text.is_blank(F.col("name"))).withColumn("key", text.preflight_key(F.col("name")))
    keyed = keyed.filter((F.col("key") != "") & ~text.is_non_item(F.col("key")))
    # A name may stand on very many rows: only the first ones of each are brought together.
    first = keyed.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("row_num"))).filter(F.col("at") <= DUPLICATE_ROWS)
    shown = first.groupBy("key").agg(F.min_by("name", "row_num").alias("name"), F.array_sort(F.collect_list("row_num")).alias("first_rows"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return counted.join(shown, "key").select("key", "n", text.snippet(F.col("name")).alias("name"), "first_rows")


def samples(rows: DataFrame, flag: str, most: int = SAMPLES) -> DataFrame:
    """``row_num, raw``: the first rows that carry one flag of :func:`checked_rows`."""
    raw = F.col("other") if flag == "blank_names" else F.col("shown")
    width = 20 if flag in ("zero", "negative", "date_like") else 60
    return checked_rows(rows).filter(F.col(flag)).orderBy("row_num").limit(most).select("row_num", text.snippet(raw, width).alias("raw"))


@dataclass(frozen=True)
class CodePattern:
    mode: str
    label: str = field(init=False)
    note: str = field(init=False)

    def __post_init__(self) -> None:
        place = {"firstToken": ("first token", "start"), "lastToken": ("last token", "end")}.get(self.mode)
        object.__setattr__(self, "label", f"codes: {place[0]}" if place else "full names")
        object.__setattr__(
            self,
            "note",
            f"Most names have an item code at their {place[1]}; in automatic mode it isn't compared."
            if place
            else "Names carry no item code that could be told; they are compared as a whole.",
        )


def code_pattern(rows: DataFrame) -> CodePattern:
    return CodePattern(detect_strip_mode(rows.filter(~text.is_blank(F.col("name"))), "name"))


def strip_example(rows: DataFrame, mode: str) -> DataFrame:
    """``raw, stripped`` of the first name that stripping changes; empty for mode none."""
    names = rows.filter(~text.is_blank(F.col("name"))).select("row_num", text.js_trim(F.col("name")).alias("raw"))
    names = names.withColumn("stripped", text.strip_code(F.col("raw"), mode)).filter("stripped <> raw and stripped <> ''")
    return names.orderBy("row_num").limit(1).select(text.snippet(F.col("raw"), 48).alias("raw"), text.snippet(F.col("stripped"), 48).alias("stripped"))
