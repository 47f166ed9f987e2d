"""Which row of a sheet is its header, and which column is what.

A sheet is ``row_num`` (1-based, blank rows counted) and ``cells``, an array of ``kind`` (num,
str, bool, null), ``s`` (as text) and ``d`` (as number).  Only the first rows and one profile
of each column reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import money, text

CELL = "struct<kind:string,s:string,d:double>"

# Words of headers, folded to plain lower case.
NAME_WORDS = re.compile(r"descript|item|product|particular|goods|material|article|spec|name|descripcion|nombre|nama|uraian|deskripsi|artikel")
PRICE_WORDS = re.compile(r"price|amount|cost|rate|value|selling|net|gross|unit\s*cost|unit\s*price|harga|precio|importe|presyo|halaga|preco|preis|prix")
DATE_WORDS = re.compile(r"date|tanggal|fecha|datum|effectivity|as\s*of")
CODE_WORDS = re.compile(r"part\s*(no|num|number)|model\s*(no|num|number|code)|product[^\n]{0,20}code|inventory\s*code|item\s*code|stock\s*(no|code)|sku|^code\b|kode|codigo")
STRONG_CODE_WORDS = re.compile(r"^code$|part\s*(no|num|number)|sku")
QTY_WORDS = re.compile(r"qty|quantity|pcs|pieces|units|sacks|boxes|dozen", re.I)
# A whole cell that is a number, with a currency in front or not.
CURRENCIES = (
    "p", "php", "ps", "usd", "eur", "gbp", "aud", "cad", "sgd", "myr", "rm", "idr", "inr", "jpy", "cny", "rmb", "thb", "vnd", "krw", "hkd", "twd",
    "zar", "ngn", "kes", "aed", "sar", "qar", "kwd", "bhd", "omr", "jod", "ils", "try", "brl", "mxn", "ars", "clp", "cop", "lak", "khr", "mmk", "bnd",
)
NUMERIC_SHAPE = rf"(?i)^[(-]*\s*[₱$€£¥]?\s*({'|'.join(CURRENCIES)})?\s*[-+]?[0-9][0-9.,\s]*\)?\z"
PLAIN_NUMBER = r"^[0-9(£$€¥₱\s.,-]+\z"

HEADER_ROWS, PROFILE_ROWS, SAMPLES = 20, 300, 3


def fold_label(s: str) -> str:
    """Lower case without diacritics; for labels only."""
    spread = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s))
    return "".join(c for c in spread if not "\u0300" <= c <= "\u036f").lower()


def looks_numeric(cell: Column) -> Column:
    """A finite number, or text that as a whole has the shape of one."""
    shown = text.js_trim(F.translate(cell["s"], "\u00a0", " "))
    as_text = (cell["kind"] == "str") & (shown != "") & shown.rlike("[0-9]") & shown.rlike(NUMERIC_SHAPE)
    return F.coalesce(F.when(cell["kind"] == "num", money.clean_number(cell["d"]).isNotNull()).otherwise(as_text), F.lit(False))


def is_filled(cell: Column) -> Column:
    return (cell["kind"] != "null") & ~text.is_blank(cell["s"])


@dataclass(frozen=True)
class SheetColumn:
    index: int
    label: str
    samples: tuple[str, ...] = ()
    string_ratio: float = 0.0
    numeric_ratio: float = 0.0


@dataclass(frozen=True)
class Mapping:
    """Where a sheet's header is (0-based) and which columns are read."""

    header_row: int
    name_col: int
    price_col: int
    code_col: int | None = None
    qty_col: int | None = None


@dataclass(frozen=True)
class AnalyzedSheet:
    columns: tuple[SheetColumn, ...]
    mapping: Mapping
    data_rows: int


def header_scores(sheet: DataFrame) -> DataFrame:
    """``row_num, filled, strings, numbers, labels`` of the first rows that have a cell."""
    top = sheet.filter(F.col("row_num") <= HEADER_ROWS).select("row_num", F.explode("cells").alias("c")).filter(is_filled(F.col("c")))
    plain = money.clean_price(text.js_trim(F.col("c.s"))).isNotNull() & text.js_trim(F.col("c.s")).rlike(PLAIN_NUMBER)
    string = F.col("c.kind") == "str"
    return top.groupBy("row_num").agg(
        F.count("*").alias("filled"), F.count_if(string).alias("strings"), F.count_if(plain).alias("numbers"), F.collect_list(F.when(string, text.js_trim(F.col("c.s")))).alias("labels")
    )


def detect_header_row(sheet: DataFrame) -> int:
    """The 0-based row that looks most like a header; 0 if none does.

    A text cell counts 1 and 3 more if it has a header's word; a number counts against.
    """
    best, at = float("-inf"), 0
    for row in sorted(header_scores(sheet).collect(), key=lambda r: r["row_num"]):
        if row["filled"] < 2:
            continue
        words = sum(bool(NAME_WORDS.search(label) or PRICE_WORDS.search(label)) for label in map(fold_label, row["labels"]))
        score = row["strings"] + 3 * words - 2 * row["numbers"]
        if score > best:
            best, at = score, row["row_num"] - 1
    return at


def column_profile(sheet: DataFrame, header_row: int) -> DataFrame:
    """``pos, filled, strings, numbers, samples`` over the first rows below the header."""
    body = sheet.filter(F.col("row_num").between(header_row + 2, header_row + 1 + PROFILE_ROWS))
    cells = body.select("row_num", F.posexplode("cells").alias("pos", "c")).filter(is_filled(F.col("c")))
    numeric = looks_numeric(F.col("c"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("row_num", text.js_trim(F.col("c.s")).alias("s")))), 1, SAMPLES)
    return cells.groupBy("pos").agg(F.count("*").alias("filled"), F.count_if(~numeric).alias("strings"), F.count_if(numeric).alias("numbers"), F.transform(first, lambda x: x["s"]).alias("samples"))


def pick_name(columns: list[SheetColumn]) -> int:
    """The column of descriptions: text, a fitting label, long samples."""

    def score(c: SheetColumn) -> float:
        mean = sum(map(len, c.samples)) / max(len(c.samples), 1)
        return 3 * c.string_ratio + 5 * bool(NAME_WORDS.search(fold_label(c.label))) + min(mean, 40) / 20

    fitting = [c for c in columns if c.string_ratio >= 0.4]
    if fitting:
        return max(fitting, key=score).index
    return max(columns, key=lambda c: c.string_ratio).index if columns else 0


def pick_price(columns: list[SheetColumn], *taken: int | None) -> int:
    """The column of prices: numbers, a fitting label, and not a date's."""
    free = [c for c in columns if c.index not in taken]
    dated = lambda c: bool(DATE_WORDS.search(fold_label(c.label)))
    fitting = [c for c in free if c.numeric_ratio >= 0.3]
    if fitting:
        return max(fitting, key=lambda c: 3 * c.numeric_ratio + 5 * bool(PRICE_WORDS.search(fold_label(c.label))) - 6 * dated(c)).index
    numeric = [c for c in free if c.numeric_ratio > 0]
    for c in [*(c for c in numeric if not dated(c)), *numeric]:
        return c.index
    return 1 if len(columns) > 1 else 0


def pick_code(columns: list[SheetColumn], name: int, price: int) -> int | None:
    """The column of part codes, by its label; none if no label fits or it is empty."""
    fitting = [c for c in columns if c.index not in (name, price) and (c.string_ratio > 0 or c.numeric_ratio > 0) and CODE_WORDS.search(fold_label(c.label))]
    if not fitting:
        return None
    return max(fitting, key=lambda c: 2 * max(c.string_ratio, c.numeric_ratio) + 3 * bool(STRONG_CODE_WORDS.search(fold_label(c.label)))).index


def pick_qty(columns: list[SheetColumn]) -> int | None:
    return next((c.index for c in columns if QTY_WORDS.search(c.label)), None)


def pick_roles(columns: list[SheetColumn], header_row: int) -> Mapping:
    """Name, then code, then price; the code once more where the price took its column."""
    name = pick_name(columns)
    code = pick_code(columns, name, -1)
    price = pick_price(columns, name, code)
    if code is None or code == price:
        code = pick_code(columns, name, price)
    return Mapping(header_row, name, price, code, pick_qty(columns))


def analyze_sheet(sheet: DataFrame, header_row: int | None = None) -> AnalyzedSheet:
    """Header, column profiles and mapping of a sheet."""
    at = detect_header_row(sheet) if header_row is None else header_row
    head = sheet.filter(F.col("row_num") == at + 1).select("cells").first()
    width = sheet.agg(F.max(F.size("cells"))).first()[0] or 0
    labels = [c["s"].strip() if c["s"] and c["s"].strip() else "" for c in (head["cells"] if head else [])]
    profiles = {r["pos"]: r for r in column_profile(sheet, at).collect()}
    columns = []
    for i in range(width):
        label = labels[i] if i < len(labels) and labels[i] else f"Column {text.column_letters(i)}"
        r = profiles.get(i)
        columns.append(SheetColumn(i, label, tuple(r["samples"]), r["strings"] / r["filled"], r["numbers"] / r["filled"]) if r else SheetColumn(i, label))
    mapping = pick_roles(columns, at)
    named = F.get("cells", F.lit(mapping.name_col))
    rows = sheet.filter((F.col("row_num") > at + 1) & F.coalesce(is_filled(named), F.lit(False))).count()
    return AnalyzedSheet(tuple(columns), mapping, rows)


def check_runnable(a: AnalyzedSheet, b: AnalyzedSheet) -> None:
    """Raise unless both sides have rows, and names and prices in different columns."""
    for side, sheet in (("claims", a), ("costing", b)):
        if sheet.mapping.name_col == sheet.mapping.price_col:
            raise ValueError(f"{side}: name and price are the same column")
        if not sheet.data_rows:
            raise ValueError(f"{side}: no data rows below the header")


def with_header(sheet: AnalyzedSheet, header_row: int) -> Mapping:
    """The mapping after another header row was chosen: columns stay, clamped to the width."""
    last = max(len(sheet.columns) - 1, 0)
    keep = lambda c: None if c is None else min(c, last)
    m = sheet.mapping
    return replace(m, header_row=header_row, name_col=keep(m.name_col), price_col=keep(m.price_col), code_col=keep(m.code_col), qty_col=keep(m.qty_col))
