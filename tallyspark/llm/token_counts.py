"""Token counts of documents, without their ids: pieces are counted once a distinct pre-token.

A byte-level vocabulary first splits a text into pre-tokens and then each of them into pieces,
whatever stands around it.  So a document's count is the sum, over its distinct pre-tokens, of
their frequency times their pieces.

The pre-tokens that most documents share would make hot keys, and most of the traffic.  A
sample of documents names the ``ahead`` most common ones; their pieces are counted first and
travel to the tasks, which add them up while reading.  All others of a document go on as
frequencies: their distinct ones are counted in Spark and joined back.  Which pre-tokens go
ahead decides what travels, never a count.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tallyspark.llm.common import settle, small_batches

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: Pre-tokens that go ahead, and documents of the sample that names them, at most.
AHEAD, SAMPLE = 60_000, 10_000
#: Characters up to which a pre-token is its own key among those ahead; longer ones have a digest.
LONG = 48

_splitters: dict = {}


def _class_of(holds: Callable[[str], bool], codes: range = range(sys.maxunicode + 1)) -> str:
    """The code points whose general category is wanted, as ranges of a pattern's class."""
    ranges: list[list[int]] = []
    for code in codes:
        if holds(unicodedata.category(chr(code))):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Splitter:
    """The pre-tokens of a text and the pieces of a pre-token, as the vocabulary's library has them.

    Texts of the basic plane are split by the vocabulary's pattern with its classes written out, which
    is the fastest; others by the pattern as it is.  Libraries know different editions of
    Unicode, so a text with a code point that is no character here goes through the
    vocabulary's own splitter, which is several times slower (a test compares all three).
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers as public
        import regex
        from tokenizers import Tokenizer

        path = public.path(vocabulary)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        split = said["pre_tokenizer"] or {}
        plain = not said["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        added = said["added_tokens"]
        if not plain or said["model"]["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{vocabulary}: counting by pre-token needs a byte-level vocabulary without a normalizer")
        whole = Tokenizer.from_file(path)
        self.model, self.own = whole.model, whole.pre_tokenizer
        self.pattern = regex.compile(public.PATTERN)
        plane = range(0x10000)
        letter, number = (_class_of(lambda c, k=k: c[0] == k, plane) for k in "LN")
        white = "".join(f"\\U{c:08x}" for c in plane if regex.match(r"\s", chr(c)))
        written = public.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
        self.basic = re.compile(written.replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]"))
        self.beyond = re.compile(f"[^{_class_of(lambda c: c != 'Cn', plane)}]")
        self.unassigned = re.compile(f"[{_class_of(lambda c: c == 'Cn')}]")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or r"(?!)")

    def _split(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond.search(text):
            return self.basic.findall(text)
        if not self.unassigned.search(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token stands in a text, and how many special strings do."""
        if not self.special.search(text):
            return Counter(self._split(text)), 0
        parts, seen = self.special.split(text), Counter()
        for part in parts:
            seen.update(self._split(part))
        return seen, len(parts) - 1

    def pieces(self, pre_token: str) -> int:
        return sum(len(self.model.tokenize(mapped)) for mapped, _ in self.own.pre_tokenize_str(pre_token))


def splitter(vocabulary: str) -> Splitter:
    if vocabulary not in _splitters:
        _splitters[vocabulary] = Splitter(vocabulary)
    return _splitters[vocabulary]


def _key(pre_token: str) -> str:
    return pre_token if len(pre_token) <= LONG else "\0" + hashlib.sha256(pre_token.encode()).hexdigest()


def _distinct(vocabulary: str):
    """``text`` -> ``pre_token, docs``, added up within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = splitter(vocabulary).frequencies
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(frequencies(text)[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "docs"])

    return run


def _pieces(vocabulary: str, keyed: bool):
    """``pre_token`` -> it (or its key) and its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = splitter(vocabulary).pieces
        for batch in batches:
            words = batch.column(0).to_pylist()
            named = pa.array(map(_key, words), pa.string()) if keyed else batch.column(0)
            yield pa.RecordBatch.from_arrays([named, pa.array(map(pieces, words), pa.int64())], ["pre_token", "pieces"])

    return run


def _frequencies(vocabulary: str, ahead):
    """``doc_id, n_bytes, text`` -> the tokens known already, and the frequencies of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies, known_pieces = splitter(vocabulary).frequencies, ahead.value.get
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            known, upto, words, times = [], [0], [], []
            for text in batch.column(2).to_pylist():
                seen, total = frequencies(text)
                for pre_token, n in seen.items():
                    pieces = known_pieces(pre_token)
                    if pieces is None and len(pre_token) > LONG:
                        pieces = known_pieces(_key(pre_token))
                    if pieces is None:
                        words.append(pre_token)
                        times.append(n)
                    else:
                        total += n * pieces
                known.append(total)
                upto.append(len(words))
            rest = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], ["pre_token", "n"])
            ids = pa.array(range(row, row + len(known)), pa.int64())
            row += len(known)
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rest)
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), batch.column(1), pa.array(known, pa.int64()), lists], ["row", "doc_id", "n_bytes", "known", "rest"])

    return run


def common_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, ahead: int = AHEAD, sample: int = SAMPLE) -> dict[str, int]:
    """Pieces of the ``ahead`` pre-tokens that most documents of a bounded sample hold."""
    share = min(1.0, sample / max(1, docs.count()))
    seen = docs.filter("text is not null").select("text").sample(share, seed=7).mapInArrow(_distinct(vocabulary), "pre_token string, docs long")
    first = seen.groupBy("pre_token").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "pre_token").limit(ahead)
    return dict(map(tuple, first.select("pre_token").mapInArrow(_pieces(vocabulary, True), "pre_token string, pieces long").collect()))


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, ahead: int = AHEAD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    As the vocabulary's library counts a text alone: no tokens added before, after or between, strings
    of special tokens in a text count as one, nothing is cut or padded.

    Null and empty texts have no bytes and no tokens.  Rows that repeat an id or a text are
    counted each for itself; a null doc_id stays null.  Texts of any length are read whole.  Other
    columns aren't read, whatever their names.  An empty table gives an empty result.

    To the driver go at most ``ahead`` keys of at most ``LONG`` characters (longer ones as digests).
    """
    small_batches(docs.sparkSession)
    common = docs.sparkSession.sparkContext.broadcast(common_pieces(docs, vocabulary, ahead, sample))
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    shape = "row long, doc_id long, n_bytes long, known long, rest array<struct<pre_token:string,n:bigint>>"
    counted = settle(read.mapInArrow(_frequencies(vocabulary, common), shape), "frequencies")

    rest = counted.select("row", F.inline("rest"))
    pieces = rest.select("pre_token").distinct().mapInArrow(_pieces(vocabulary, False), "pre_token string, pieces long")
    sums = rest.join(pieces, "pre_token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return counted.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
