"""Header and column inference, file health, workbooks."""

import io
import zipfile

from pyspark.sql import functions as F

from tallyspark.operators import infer
from tallyspark.sources import workbook

CELLS = "row_num int, cells array<struct<kind string, s string, d double>>"


def cell(x):
    if x is None:
        return (None or "null", None, None)
    return ("str", x, None) if isinstance(x, str) else ("num", str(x), float(x))


def sheet(spark, rows):
    return spark.createDataFrame([(i, [cell(x) for x in r]) for i, r in enumerate(rows, 1)], CELLS)


# Sheets of a made-up shop: a header below a letterhead; one in another language; a column of
# numbers that aren't prices before the price; accents.
LETTERHEAD = [["Kestrel Garden Goods"], ["Stock list, spring"], [None], ["SKU", "Item name", "Cost (USD)"], ["KG-0001", "Rain barrel oak 80 l", "120.00"], ["KG-0002", "Twine jute ball", "2.10"]]
ABROAD = [["Toko Kebun Baru"], [None], ["Kode", "Nama Barang", "Harga"], ["T-1", "Ember seng 9 liter", "18.400"], ["T-2", "Sekop kayu lebar", "7.000"]]
SERIALS = [["Item description", "Received on", "Unit cost"], ["Hose reel wall mounted", 46100, "64.90"], ["Seed tray 24 cells", 46107, "3.30"], ["Trowel ash handle", 46093, "7"]]
ACCENTED = [["Descripción", "Precio"], ["Regadera cinc 9 litros", "18.40"], ["Paleta de jardín ancha", "7.00"]]


def test_roles_of_columns(spark):
    for rows, header, name, price in ((LETTERHEAD, 3, 1, 2), (ABROAD, 2, 1, 2), (SERIALS, 0, 0, 2), (ACCENTED, 0, 0, 1)):
        m = infer.analyze_sheet(sheet(spark, rows)).mapping
        assert (m.header_row, m.name_col, m.price_col) == (header, name, price)
    assert infer.analyze_sheet(sheet(spark, LETTERHEAD)).mapping.code_col == 0


def test_looks_numeric(spark):
    cases = {"₱88.10": True, "P 2,040.00": True, "KG-0001 Rain barrel": False, "9 liters": False}
    df = spark.createDataFrame([(i, cell(x)) for i, x in enumerate(cases)], "i int, c struct<kind string, s string, d double>")
    assert [r["n"] for r in df.select("i", infer.looks_numeric(F.col("c")).alias("n")).orderBy("i").collect()] == list(cases.values())


def test_rows_below_the_header_reach_the_engine(spark):
    table = sheet(spark, LETTERHEAD + [[None, None, "7"]])
    rows = workbook.engine_rows(table, infer.analyze_sheet(table).mapping).orderBy("row_num").collect()
    assert [(r["row_num"], r["raw_name"], r["raw_price"], r["raw_code"]) for r in rows] == [(5, "Rain barrel oak 80 l", 120.0, "KG-0001"), (6, "Twine jute ball", 2.1, "KG-0002")]


def test_a_run_from_sheets(spark):
    from tallyspark.plans.reconcile import compare_sheets

    costing = sheet(spark, [["Description", "Price", "Qty"], ["rain barrel, OAK - 80 L", "110", "4"], ["Twine cotton ball", "2", "1"]])
    claims = sheet(spark, LETTERHEAD)
    results = compare_sheets(claims, infer.analyze_sheet(claims), costing, infer.analyze_sheet(costing)).results.collect()
    assert {r["a_row"]: (r["status"], r["difference"]) for r in results} == {5: ("STRONG", -10.0), 6: ("UNMATCHED", None)}


def test_workbook(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Prices" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Item</t></si><si><r><t>Nut </t></r><r><t>M8</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>2.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "book.xlsx").write_bytes(raw.getvalue())
    got = {r["row_num"]: [(c["kind"], c["s"]) for c in r["cells"]] for r in workbook.read_workbook(spark, str(tmp_path / "book.xlsx")).collect()}
    assert got == {1: [("str", "Item")], 2: [], 3: [("str", "Nut M8"), ("null", None), ("num", "2.5")]}


def test_another_header_row_keeps_the_columns(spark):
    known = infer.analyze_sheet(sheet(spark, LETTERHEAD))
    m = infer.with_header(known, 4)
    assert (m.header_row, m.name_col, m.price_col, m.code_col, m.qty_col) == (4, 1, 2, 0, None)
    again = infer.analyze_sheet(sheet(spark, LETTERHEAD), header_row=4)
    assert again.mapping.header_row == 4 and again.data_rows == 1


def test_many_sheets_in_one_job_as_one_by_one(spark):
    from functools import reduce

    from pyspark.sql import DataFrame

    from tallyspark.operators import sheets

    books = {"letterhead": LETTERHEAD, "abroad": ABROAD, "serials": SERIALS, "accented": ACCENTED, "empty": [[None]], "one cell": [["x"]]}
    many = reduce(DataFrame.unionByName, [sheet(spark, rows).select(F.lit("f").alias("file"), F.lit(name).alias("sheet"), "row_num", "cells") for name, rows in books.items()])
    roles = {r["sheet"]: r for r in sheets.sheet_roles(many).collect()}
    assert set(roles) == set(books)
    for name, rows in books.items():
        one, got = infer.analyze_sheet(sheet(spark, rows)), roles[name]
        m = one.mapping
        assert (got["header_row"], got["name_col"], got["price_col"], got["code_col"], got["qty_col"], got["data_rows"]) == (m.header_row, m.name_col, m.price_col, m.code_col, m.qty_col, one.data_rows), name
        assert got["runnable"] == (m.name_col != m.price_col and one.data_rows > 0)
    read = sheets.sheet_rows(many, sheets.sheet_roles(many)).filter("sheet = 'letterhead'").orderBy("row_num").collect()
    assert [(r["row_num"], r["raw_name"], r["raw_price"], r["raw_code"]) for r in read] == [(5, "Rain barrel oak 80 l", 120.0, "KG-0001"), (6, "Twine jute ball", 2.1, "KG-0002")]
