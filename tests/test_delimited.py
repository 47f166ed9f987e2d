"""Delimited files split anywhere, against one pass with the csv module."""

import csv
import io
import random

import pytest

from tallyspark.sources.delimited import ends_inside, read_delimited, typed_cell

PIECES = ["oak desk", "5", "-3.5", "", '2" pipe', 'he said "so"', "a,b", "line one\nline two", "\n\n", '"', "né à Å", "x" * 40, " ", "1e3", "\r\nmid"]


def whole_file(seed, n, end="\n"):
    rng = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    for _ in range(n):
        writer.writerow([rng.choice(PIECES) for _ in range(rng.randint(1, 4))])
        if rng.random() < 0.1:
            out.write(rng.choice([end, f'2" pipe,"a""b",c{end}', f'"x"y,z{end}', f',,{end}']))
    return out.getvalue()


def plain(text):
    rows = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))
    return [[typed_cell(c) for c in row] for row in rows]


@pytest.fixture
def tiny_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "97")
    spark.conf.set(keys[1], "1")
    spark.conf.set(keys[2], "200")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("end,broadcast", [("\n", 100_000), ("\r\n", 0)])
def test_rows_and_numbers_equal_one_pass(spark, tmp_path, tiny_splits, end, broadcast):
    texts = {f"f{seed}.csv": ("﻿" if seed == 1 else "") + whole_file(seed, 120, end) for seed in range(3)}
    texts["empty.csv"] = ""
    texts["open.csv"] = f'a,b{end}c,"never closed{end}d,e{end}'
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    table = read_delimited(spark, str(tmp_path), broadcast_splits=broadcast)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 60
    got = {}
    for r in table.collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["row_num"], [tuple(c) for c in r["cells"]]))
    for name, t in texts.items():
        if name == "open.csv":
            assert [n for n, _ in sorted(got[name])] == [1, 2]
            continue
        assert [cells for _, cells in sorted(got.get(name, []))] == plain(t), name
        assert [n for n, _ in sorted(got.get(name, []))] == list(range(1, len(plain(t)) + 1))


def test_where_a_quoted_cell_is_open():
    for line, inside, want in (
        ("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('b",c', False, False), ('2" pipe,"', False, True), ('""', True, True), ('"",""', False, False), ('"a"b"c,"', False, True), ("", True, True), ('x""y', True, True),
    ):
        assert ends_inside(line, inside) is want, line
