"""Delimited files of any size as sheets: split anywhere, every row with its number.

Spark's text reader deals a file out at line ends, but a quoted cell can hold line ends, and a row's
number depends on all rows before it.  So the file is scanned twice.  The first scan says of each
split, for both cases (it begins outside or inside a quoted cell), how many rows end in it
and where it ends; put together in order, these say how each split really begins.  The second
scan reads the rows.  A row that lies over a split's end is put together from its pieces.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.shared import settle

SHEET_SCHEMA = "file string, sheet string, row_num int, cells array<struct<kind:string,s:string,d:double>>"
CELLS = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.string()), ("d", pa.float64())]))
#: Splits up to which their beginnings are sent to every task (about 100 bytes each); beyond it
#: lines are sorted to their split's beginning instead.
BROADCAST_SPLITS = 100_000
#: Rows of a batch that is handed back.
BATCH_ROWS = 5_000

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def typed_cell(raw: str) -> tuple[str, str | None, float | None]:
    """A cell of text: empty, a plain number, or text."""
    if raw == "":
        return "null", None, None
    if _NUMBER.fullmatch(raw):
        return "num", raw, float(raw)
    return "str", raw, None


def ends_inside(line: str, inside: bool, separator: str = ",") -> bool:
    """Whether a quoted cell is open after a line; a quote opens a cell only where one begins."""
    at, fresh = 0, not inside
    while True:
        if inside:
            close = line.find('"', at)
            if close < 0:
                return True
            at = close + 1
            if line[at : at + 1] == '"':  # a quote in the cell
                at += 1
                continue
            inside = False
            fresh = line[at : at + 1] == separator
            at += fresh
        elif fresh and line[at : at + 1] == '"':
            inside, at = True, at + 1
        else:
            at = line.find(separator, at)
            if at < 0:
                return False
            at, fresh = at + 1, True


def _groups(*columns: pa.Array) -> list[tuple[int, int]]:
    """Runs of equal neighbours."""
    n = len(columns[0])
    cut = np.zeros(n, bool)
    cut[:1] = True
    for c in columns:
        values = c.to_numpy(zero_copy_only=False)
        cut[1:] |= values[1:] != values[:-1]
    at = np.flatnonzero(cut).tolist()
    return list(zip(at, [*at[1:], n]))


def _scan(separator: str):
    """``value, file, block`` -> for each split (in pieces of a batch, in order) what it does to either beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = 0
        for batch in batches:
            value, file, block = batch.columns
            out = []
            for a, b in _groups(file, block):
                lines = value.slice(a, b - a)
                quoted = np.flatnonzero(pc.fill_null(pc.match_substring(lines, '"'), False).to_numpy(zero_copy_only=False))
                said = []
                for inside in (False, True):
                    rows, done = 0, 0
                    for i in quoted.tolist():
                        rows += 0 if inside else i - done
                        inside = ends_inside(lines[i].as_py(), inside, separator)
                        rows += not inside
                        done = i + 1
                    said += [rows + (0 if inside else b - a - done), inside]
                out.append((file[a].as_py(), block[a].as_py(), order, *said))
                order += 1
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "piece", "rows_out", "ends_out", "rows_in", "ends_in"])

    return run


def _beginnings(pieces: pd.DataFrame) -> pd.DataFrame:
    """All splits of one file -> where each begins: ``file, block, inside, rows_before``."""
    inside, rows, out, last = False, 0, [], None
    for p in pieces.sort_values(["block", "piece"]).itertuples():
        if p.block != last:
            out.append((p.file, p.block, inside, rows))
            last = p.block
        rows += p.rows_in if inside else p.rows_out
        inside = p.ends_in if inside else p.ends_out
    return pd.DataFrame(out, columns=["file", "block", "inside", "rows_before"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    cells = pa.array([None if r is None else [{"kind": k, "s": s, "d": d} for k, s, d in map(typed_cell, r)] for r in columns[2]], CELLS)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), cells, pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())],
        ["file", "row_num", "cells", "block", "piece"],
    )


def _records(separator: str):
    """``value, file, block, inside, rows_before`` in order -> rows with their cells, and pieces of rows."""

    def whole(file: str, number: int, lines: list[str], block: int, began: bool, ended: bool) -> tuple:
        text = "\n".join(lines)
        if began and ended:
            return file, number, next(csv.reader([text.removesuffix("\r")], delimiter=separator), []), block, None
        return file, number, None, block, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, number, inside, began = None, [], 0, False, True
        out: list[tuple] = []
        for batch in batches:
            for line, file, block, starts_inside, before in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != now:
                    if held:
                        out.append(whole(now[0], number, held, now[1], began, False))
                    now, held, number, inside, began = (file, block), [], before + 1, starts_inside, not starts_inside
                held.append(line)
                if inside or '"' in line:
                    inside = ends_inside(line, inside, separator)
                if not inside:
                    out.append(whole(file, number, held, block, began, True))
                    held, number, began = [], number + 1, True
                if len(out) >= BATCH_ROWS:
                    yield _batch(out)
                    out = []
        if held:
            out.append(whole(now[0], number, held, now[1], began, False))
        yield _batch(out)

    return run


def _joined(separator: str):
    """``file, row_num, text`` of rows that lay over splits -> their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _batch([(file, n, next(csv.reader([text.removesuffix("\r")], delimiter=separator), []), 0, None) for file, n, text in rows])

    return run


def read_delimited(spark: SparkSession, path: str, separator: str = ",", broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """Delimited UTF-8 files as sheets (``file, sheet, row_num, cells``; ``sheet`` is empty).

    Every row keeps its number, blank ones too; quoted cells may hold separators, quotes (doubled)
    and line ends.  Lines end with a line feed, before it a carriage return may stand.  A byte
    order mark (also at the start of a line) is left out; a quote that is never closed takes the rest of the file, as one cell.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    scanned = lines.mapInArrow(_scan(separator), "file string, block long, piece long, rows_out long, ends_out boolean, rows_in long, ends_in boolean")
    begins = settle(scanned.groupBy("file").applyInPandas(_beginnings, "file string, block long, inside boolean, rows_before long"), "split-beginnings")
    shape = "file string, row_num int, cells array<struct<kind:string,s:string,d:double>>, block long, piece string"
    if begins.count() <= broadcast_splits:
        placed = lines.join(F.broadcast(begins), ["file", "block"])  # keeps the order of the lines
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(begins, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    read = settle(placed.select("value", "file", "block", "inside", "rows_before").mapInArrow(_records(separator), shape), "sheet-rows")
    pieces = F.array_sort(F.collect_list(F.struct("block", "piece")))
    broken = read.filter("piece is not null").groupBy("file", "row_num").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "\n").alias("text"))
    mended = broken.select("file", "row_num", "text").mapInArrow(_joined(separator), shape)
    rows = read.filter("piece is null").unionByName(mended)
    return rows.select("file", F.lit("").alias("sheet"), "row_num", F.coalesce("cells", F.array().cast("array<struct<kind:string,s:string,d:double>>")).alias("cells"))
