"""Sheets as tables of cells, from typed tables and spreadsheets; delimited text is :mod:`delimited`'s."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tallyspark.functions import text
from tallyspark.operators.infer import Mapping, is_filled
from tallyspark.sources.delimited import SHEET_SCHEMA

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def number_text(d: Column) -> Column:
    """A number as a sheet shows it: whole ones without a point."""
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), F.floor(d).cast("string")).otherwise(d.cast("string"))


def cell(column: Column, kind) -> Column:
    """A typed column as a cell: its kind is the column's type."""
    null = F.lit(None)
    if isinstance(kind, NumericType):
        d = column.cast("double")
        return F.struct(F.when(column.isNull(), "null").otherwise("num").alias("kind"), number_text(d).alias("s"), d.alias("d"))
    name = "bool" if isinstance(kind, BooleanType) else "str"
    return F.struct(F.when(column.isNull(), "null").otherwise(name).alias("kind"), column.cast("string").alias("s"), null.cast("double").alias("d"))


def sheet_of_table(df: DataFrame, row_num: str, columns: list[str]) -> DataFrame:
    """A typed table as a sheet without a header row; ``row_num`` names its row numbers."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = F.array(*[cell(F.col(c), kinds[c]) for c in columns])
    return df.select(F.col(row_num).cast("int").alias("row_num"), cells.alias("cells"))


def _batch(file: str, rows: list[tuple]):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.string()), ("d", pa.float64())]))
    columns = list(zip(*rows)) if rows else [[], [], []]
    arrays = [pa.array([file] * len(rows), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], kind)]
    return pa.RecordBatch.from_arrays(arrays, ["file", "sheet", "row_num", "cells"])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of ``.xlsx`` files: ``file, sheet, row_num, cells``; one file is one task's.

    Blank rows keep their numbers.  The files are read through Spark, so any store will do.  A sheet
    has 1,048,576 rows at most by its format; what one task holds is one file.
    """

    def rows(files):
        for part in files:
            for file, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                for name, table in parse_xlsx(content):
                    for at in range(0, len(table), 5000):
                        yield _batch(file, [(name, i, cells) for i, cells in table[at : at + 5000]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, SHEET_SCHEMA)


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def parse_xlsx(content: bytes) -> list[tuple[str, list[tuple[int, list[dict]]]]]:
    """A spreadsheet's sheets: name, and rows as (row number, cells)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS):
            table: dict[int, list[dict]] = {}
            root = ElementTree.fromstring(z.read("xl/" + targets[sheet.get(f"{{{_NS['r']}}}id")]))
            for number, row in enumerate(root.findall("m:sheetData/m:row", _NS), 1):
                cells: list[dict] = []
                for place, c in enumerate(row.findall("m:c", _NS)):
                    i = _column_number(c.get("r")) if c.get("r") else place
                    cells += [{"kind": "null", "s": None, "d": None}] * (i - len(cells))
                    cells.append(_xlsx_cell(c, shared))
                table[int(row.get("r") or number)] = cells
            out.append((sheet.get("name"), [(i, table.get(i, [])) for i in range(1, max(table, default=0) + 1)]))
        return out


def _xlsx_cell(c, shared: list[str]) -> dict:
    kind, value = c.get("t"), c.find("m:v", _NS)
    raw = None if value is None else value.text
    if kind == "inlineStr":
        return {"kind": "str", "s": "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")), "d": None}
    if raw is None:
        return {"kind": "null", "s": None, "d": None}
    if kind == "s":
        return {"kind": "str", "s": shared[int(raw)], "d": None}
    if kind == "b":
        return {"kind": "bool", "s": "true" if raw == "1" else "false", "d": None}
    if kind in ("str", "e"):
        return {"kind": "str", "s": raw, "d": None}
    d = float(raw)
    return {"kind": "num", "s": str(int(d)) if d == int(d) and abs(d) < 1e15 else repr(d), "d": d}


def _field(index: int | None) -> Column:
    return F.get("cells", F.lit(-1 if index is None else index))


def engine_rows(sheet: DataFrame, mapping: Mapping) -> DataFrame:
    """``row_num, raw_name, raw_price, raw_code, raw_qty`` of the rows below the header that have a name.

    Prices keep their kind: a number is written so that it reads back as itself.
    """
    body = sheet.filter(F.col("row_num") > mapping.header_row + 1)
    name = _field(mapping.name_col)
    plain = lambda c: F.when(c["kind"] == "num", number_text(c["d"])).when(c["kind"] == "str", c["s"])
    rows = body.filter(F.coalesce(is_filled(name), F.lit(False)))
    price = _field(mapping.price_col)
    qty = _field(mapping.qty_col) if mapping.qty_col is not None else None
    return rows.select(
        F.col("row_num").cast("long").alias("row_num"),
        text.js_trim(name["s"]).alias("raw_name"),
        typed_price(price).alias("raw_price"),
        (plain(_field(mapping.code_col)) if mapping.code_col is not None else F.lit(None).cast("string")).alias("raw_code"),
        (typed_price(qty) if qty is not None else F.lit(None).cast("double")).alias("raw_qty"),
    )


def typed_price(c: Column) -> Column:
    """A cell's price: numbers as they are, text as typed prices are read, booleans not at all."""
    from tallyspark.functions import money

    return F.when(c["kind"] == "num", money.clean_number(c["d"])).when(c["kind"] == "str", money.clean_price(c["s"]))


def preview(sheet: DataFrame, header_row: int, rows: int = 8, columns: int = 8) -> DataFrame:
    """The first rows below the header, as text."""
    body = sheet.filter(F.col("row_num").between(header_row + 2, header_row + 1 + rows))
    return body.orderBy("row_num").select("row_num", *[F.get("cells", F.lit(i))["s"].alias(text.column_letters(i)) for i in range(columns)])
