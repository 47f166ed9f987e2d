"""Packing token sequences into fixed-length training sequences, best fit, as a tree.

Documents are tokenised where they lie.  Pieces of full length are sequences by
themselves; the rest of a document (shorter than a sequence) is an item.  Each
partition packs its items best-fit, emits the bins that are nearly full, and hands the
underfull ones up as items of the next round, which has fewer partitions.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import settle, small_batches

CAPACITY, END_ID = 1024, 2
#: A bin with at most so many free tokens is emitted.
SLACK = 4
#: Items a partition packs in a round, and pieces for each of them on average, at most.
ITEMS_PER_TASK, PIECES_AN_ITEM = 50_000, 4

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN = f"used int, members array<struct<{', '.join(c.replace(' ', ':', 1) for c in PIECE.split(', '))}>>"

_encoders: dict = {}


class Encoder:
    """Ids of the vocabulary ``byte_bpe_50k`` (the same from both of its files).

    Texts of Latin letters go through the rank file, which is several times faster; all
    others through the ``tokenizers`` file, whose rules about characters are the standard.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public.path(f"{vocabulary}.json"))
        self.slow.encode_special_tokens = True
        with open(public.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("[^\x00-ɏ‐-‧]")

    def ids(self, text: str) -> np.ndarray:
        if self.other.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def tokenise(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, text`` -> one row a piece: ``doc_id, piece, start, length, ids_crc32``.

    A document is its text's ids and ``end_id``; null text is empty, so that every document
    has at least one token.  Only documents longer than ``capacity`` are cut; all pieces
    but the first have ``capacity`` tokens.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).ids
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(ids_of(text or ""), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                raw = memoryview(ids).cast("B")
                out += [(doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items in each bin; ties by position."""
    bins: list[list[int]] = []
    open_: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(open_, (sizes[i], -1))
        if at == len(open_):
            bins.append([i])
            free, into = capacity - sizes[i], len(bins) - 1
        else:
            free, into = open_.pop(at)
            bins[into].append(i)
            free -= sizes[i]
        if free:
            insort(open_, (free, into))
    return bins


def _packer(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, members = [], []
        for batch in batches:
            sizes += batch.column(0).to_pylist()
            members += batch.column(1).to_pylist()
        packed = best_fit(sizes, capacity)
        schema = pa.schema([("used", pa.int32()), ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))])
        for at in range(0, len(packed), 5000):
            part = packed[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([sum(sizes[i] for i in b) for b in part], pa.int32()), pa.array([[m for i in b for m in members[i]] for b in part], schema.field(1).type)], schema=schema)

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Pieces -> the same with ``sequence_id, offset``; no sequence holds over ``capacity`` tokens.

    Rounds: items are dealt in turn to ``items / items_per_task`` partitions, each packs
    best-fit and emits nearly full bins; underfull bins are the items of the next round, on
    as many partitions as they and their pieces need, until one partition has packed what is left.
    Where a round doesn't halve the partitions, lengths fit badly: items are dealt once by
    length, each beside those of the complementary length, and if a later round stalls
    again, what is left is emitted as it is, from all partitions.
    """
    single = pieces.filter(F.col("length") >= capacity)
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    open_ = pieces.filter(F.col("length") < capacity).select(F.col("length").cast("int").alias("used"), F.array(item).alias("members"))
    full = [single.select(F.col("length").cast("int").alias("used"), F.array(item).alias("members"))]

    def tasks_for(items: DataFrame) -> int:
        n = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("pieces")).first()
        return max(1, -(-n["items"] // items_per_task), -(-n["pieces"] // (PIECES_AN_ITEM * items_per_task)))

    tasks, by_length, was_by_length = tasks_for(open_), False, False
    while True:
        if tasks == 1:
            dealt = open_.coalesce(1)
        elif by_length:  # an item and what would fill its bin have the same key; the number deals out rows alike
            numbered = open_.withColumn("at", F.xxhash64(F.monotonically_increasing_id()))
            dealt = numbered.repartitionByRange(tasks, F.least(F.col("used"), capacity - F.col("used")), "at")
        else:
            dealt = open_.repartition(tasks)
        packed = settle(dealt.select("used", "members").mapInArrow(_packer(capacity), BIN), "packed")
        if tasks == 1:
            full.append(packed)
            break
        full.append(packed.filter(F.col("used") >= capacity - slack))
        open_ = packed.filter(F.col("used") < capacity - slack)
        left = tasks_for(open_)
        stalled = 2 * left > tasks + 1
        if stalled and was_by_length:
            full.append(open_)
            break
        tasks, by_length, was_by_length = left, stalled, was_by_length or stalled
    bins = full[0]
    for more in full[1:]:
        bins = bins.unionByName(more)
    before = F.aggregate(F.slice("members", 1, F.col("at")), F.lit(0).cast("long"), lambda s, m: s + m["length"])
    return (
        bins.withColumn("sequence_id", F.monotonically_increasing_id())
        .select("sequence_id", "members", F.posexplode("members").alias("at", "m"))
        .select("m.*", "sequence_id", before.alias("offset"))
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, text`` -> one row a piece with its sequence and offset.

    Null and empty texts are documents of one token (``end_id``).  Repeated rows are packed
    as often as they occur; a null doc_id stays null; texts of any length are read whole; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    pieces = settle(tokenise(docs, capacity, end_id, vocabulary), "pieces")
    return pack_pieces(pieces, capacity)
