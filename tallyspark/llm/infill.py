"""Fill-in-the-middle: texts cut at two unit boundaries, and put together in another order.

A unit is a word with the white space before it; white space at the end of a text is a
unit too.  A text is an array of code points: where the class of neighbours changes from word
to white space a unit ends.  Two ranks, fixed by the document's id, choose the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import small_batches

PLAIN, PSM, SPM = "plain", "psm", "spm"


class Markers(NamedTuple):
    """What stands before each part; a text that holds one of them stays plain."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def check(self) -> Markers:
        """No marker may begin as one ends: each then occurs in an output only where it was put."""
        for a in self:
            for b in self:
                if not a or any(a.endswith(b[:k]) for k in range(1, len(b))) or (a is not b and a in b):
                    raise ValueError(f"markers {a!r} and {b!r} can run into each other")
        return self


def unit_ends(codes: np.ndarray) -> np.ndarray:
    """Where each unit of a text ends: after every word, and at the end."""
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    inside = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return np.append(inside, len(codes)) if len(codes) else inside


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 from the seed and the decimal id (null: no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def arrange(text: str, doc_id: int | None, seed: int, rate: int, spm_rate: int, marks: Markers) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = unit_ends(codes)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = np.concatenate([[0], ends])
    a, b = at[first], at[second]
    prefix, middle, suffix = (codes[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(codes))))
    if h4 % 100 < spm_rate:
        return n, SPM, int(a), int(b - a), marks.suffix + suffix + marks.prefix + prefix + marks.middle + middle
    return n, PSM, int(a), int(b - a), marks.prefix + prefix + marks.suffix + suffix + marks.middle + middle


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, markers: Markers = Markers()) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``rate`` of a hundred texts are cut, ``spm_rate`` of a hundred of those with the suffix
    first.  The cuts depend on seed, id and text alone, so reruns and lost executors change
    nothing.  Lengths count code points and are null in the plain form.

    Null text is empty.  Empty texts, texts that hold a marker and texts not drawn are plain:
    the output is the text.  A null doc_id draws as an id without digits.  Rows that repeat
    are each returned, alike.  A text of any length is read whole, at 4 bytes a code point.  Other
    columns aren't read, whatever their names; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    marks = Markers(*markers).check()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [arrange(text or "", doc_id, seed, rate, spm_rate, marks) for doc_id, text in zip(ids, batch.column(1).to_pylist())]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that an output was made of, read back from its markers."""
    marks = Markers(*markers).check()

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(marks.prefix if second == marks.suffix else marks.suffix) + 1, 2147483647)
        tail = F.substring_index(body, second, -1)
        return F.substring_index(body, second, 1), F.substring_index(tail, marks.middle, 1), F.substring_index(tail, marks.middle, -1)

    prefix, suffix, middle = parts(marks.suffix)
    last, first, between = parts(marks.prefix)
    return F.when(form == PSM, F.concat(prefix, middle, suffix)).when(form == SPM, F.concat(first, between, last)).otherwise(output)
