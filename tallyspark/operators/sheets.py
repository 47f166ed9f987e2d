"""Headers, columns and rows of many sheets in one job.

What :mod:`tallyspark.operators.infer` does for one sheet, as grouped aggregates over a table of cells
(``file, sheet, row_num, cells``): a folder of sheets gives one row each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyspark.functions import money, text
from tallyspark.operators import infer
from tallyspark.sources.shared import settle

SHEET = ["file", "sheet"]
ROLES = "file string, sheet string, header_row int, name_col int, price_col int, code_col int, qty_col int"


@F.pandas_udf(StringType())
def folded(labels: pd.Series) -> pd.Series:
    """Labels in lower case without diacritics; only the first rows of a sheet are labels."""
    return labels.map(infer.fold_label, na_action="ignore")


def header_rows(sheets: DataFrame) -> DataFrame:
    """``file, sheet, header_row`` (0-based): the row that looks most like a header, the first of equals."""
    top = sheets.filter(F.col("row_num") <= infer.HEADER_ROWS).select(*SHEET, "row_num", F.explode("cells").alias("c")).filter(infer.is_filled(F.col("c")))
    shown, string = text.js_trim(F.col("c.s")), F.col("c.kind") == "str"
    top = top.select(*SHEET, "row_num", shown.alias("shown"), string.alias("string"), folded(F.when(string, shown)).alias("label"))
    words = F.coalesce(F.col("label").rlike(infer.NAME_WORDS.pattern) | F.col("label").rlike(infer.PRICE_WORDS.pattern), F.lit(False))
    plain = money.clean_price(F.col("shown")).isNotNull() & F.col("shown").rlike(infer.PLAIN_NUMBER)
    scores = top.groupBy(*SHEET, "row_num").agg(F.count("*").alias("filled"), (F.count_if("string") + 3 * F.count_if(words) - 2 * F.count_if(plain)).alias("score"))
    best = scores.filter("filled >= 2").groupBy(*SHEET).agg(F.max_by("row_num", F.struct("score", -F.col("row_num"))).alias("row_num"))
    every = sheets.select(*SHEET).distinct()
    return every.join(best, SHEET, "left").select(*SHEET, (F.coalesce("row_num", F.lit(1)) - 1).alias("header_row"))


def sheet_columns(sheets: DataFrame, headers: DataFrame) -> DataFrame:
    """``file, sheet, header_row, pos, label, filled, strings, numbers, samples``: each column's profile."""
    below = sheets.join(headers, SHEET)
    width = below.groupBy(*SHEET, "header_row").agg(F.max(F.size("cells")).alias("width"))
    every = width.filter("width > 0").select(*SHEET, "header_row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("pos"))
    head = below.filter(F.col("row_num") == F.col("header_row") + 1).select(*SHEET, F.posexplode("cells").alias("pos", "c"))
    head = head.select(*SHEET, "pos", F.nullif(text.js_trim(F.col("c.s")), F.lit("")).alias("label"))
    body = below.filter(F.col("row_num").between(F.col("header_row") + 2, F.col("header_row") + 1 + infer.PROFILE_ROWS))
    cells = body.select(*SHEET, "row_num", F.posexplode("cells").alias("pos", "c")).filter(infer.is_filled(F.col("c")))
    numeric = infer.looks_numeric(F.col("c"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("row_num", text.js_trim(F.col("c.s")).alias("s")))), 1, infer.SAMPLES)
    profile = cells.groupBy(*SHEET, "pos").agg(
        F.count("*").alias("filled"), F.count_if(~numeric).alias("strings"), F.count_if(numeric).alias("numbers"), F.transform(first, lambda x: x["s"]).alias("samples")
    )
    return every.join(head, [*SHEET, "pos"], "left").join(profile, [*SHEET, "pos"], "left")


def _pick(columns: pd.DataFrame) -> pd.DataFrame:
    """A sheet's columns -> its roles."""
    known = []
    for c in columns.sort_values("pos").itertuples():
        label = c.label or f"Column {text.column_letters(c.pos)}"
        filled = c.filled if c.filled == c.filled and c.filled else 0
        known.append(infer.SheetColumn(c.pos, label, tuple(c.samples) if filled else (), c.strings / filled if filled else 0.0, c.numbers / filled if filled else 0.0))
    m = infer.pick_roles(known, int(columns["header_row"].iloc[0]))
    row = (columns["file"].iloc[0], columns["sheet"].iloc[0], m.header_row, m.name_col, m.price_col, m.code_col, m.qty_col)
    kinds = {c: "Int32" for c in ("header_row", "name_col", "price_col", "code_col", "qty_col")}
    return pd.DataFrame([row], columns=["file", "sheet", *kinds]).astype(kinds)


def sheet_roles(sheets: DataFrame) -> DataFrame:
    """One row a sheet: ``file, sheet, header_row, name_col, price_col, code_col, qty_col, data_rows, runnable``.

    Columns count from 0; code and quantity may be missing.  ``runnable``: there are rows with a name,
    and names and prices are different columns.  Sheets without a cell have no row.
    """
    roles = settle(sheet_columns(sheets, header_rows(sheets)).groupBy(*SHEET).applyInPandas(_pick, ROLES), "sheet-roles")
    named = F.coalesce(infer.is_filled(F.get("cells", F.col("name_col"))), F.lit(False))
    rows = sheets.join(roles, SHEET).groupBy(*SHEET).agg(F.count_if((F.col("row_num") > F.col("header_row") + 1) & named).alias("data_rows"))
    return roles.join(rows, SHEET).withColumn("runnable", (F.col("name_col") != F.col("price_col")) & (F.col("data_rows") > 0))


def sheet_rows(sheets: DataFrame, roles: DataFrame) -> DataFrame:
    """``file, sheet, row_num, raw_name, raw_price, raw_code, raw_qty`` of all rows that have a name, of runnable sheets."""
    from tallyspark.sources.workbook import number_text, typed_price

    body = sheets.join(roles.filter("runnable"), SHEET).filter(F.col("row_num") > F.col("header_row") + 1)
    at = lambda c: F.get("cells", F.col(c))
    code = at("code_col")
    rows = body.filter(F.coalesce(infer.is_filled(at("name_col")), F.lit(False)))
    return rows.select(
        *SHEET,
        "row_num",
        text.js_trim(at("name_col")["s"]).alias("raw_name"),
        typed_price(at("price_col")).alias("raw_price"),
        F.when(code["kind"] == "num", number_text(code["d"])).when(code["kind"] == "str", code["s"]).alias("raw_code"),
        typed_price(at("qty_col")).alias("raw_qty"),
    )
