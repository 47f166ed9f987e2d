"""The prefix trie of conversations: which sequences of first turns they share.

A turn is the SHA-256 of its role and text, a conversation the sequence of its turns'
digests.  Sorted as a whole (range partitions, then inside each), conversations that share
their first ``d`` turns lie together.  A sweep over a partition keeps the path of the last
conversation on a stack: the longest common prefix with the next one says which nodes end, and
a node that ends knows its interval.  Nodes on the path of a partition's first or last
conversation may go on in the neighbouring partition; these pieces, a few for each partition
and not for each conversation, are put together by one more sweep over all partitions' stacks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tallyspark.llm.common import settle, small_batches, word_count

#: Turns of a range partition, about.
TURNS_PER_TASK = 200_000
#: Bytes of a turn's digest.
SYMBOL = 32

NODE, PIECE, ENDS = 0, 1, 2
#: What a sweep writes: nodes that ended (their parent's id, or the open path the parent is on), pieces
#: of nodes that may go on elsewhere, and the ids that end at such a node.
SWEPT = (
    "kind int, part int, side int, depth int, start long, digest binary, parent_digest binary, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
)
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), ("depth", pa.int32()), ("start", pa.int64()), ("digest", pa.binary()), ("parent_digest", pa.binary())]
    + [(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")]
    + [("ends", pa.string())]
)
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _batches(rows: list[tuple], least: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of ``SWEPT`` as batches; empties the list."""
    if len(rows) > least:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
        rows.clear()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> ``conv_id, turns``: digests (hex) and words of its turns in order.

    Null turns come first; turns of one number are ordered by their digest.  A null role or text
    is empty.  Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct("turn", digest.alias("digest"), word_count(text).alias("words")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def share_heads(arrays: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first ``h`` turns from the one that starts its twenty.

    ``h`` is the CRC32 of the decimal id modulo ``most``; the head comes from conversation
    ``id - id % every`` (all its turns if it has fewer, none if it doesn't exist); the remainder has
    the id's sign, as in SQL.
    """
    heads = arrays.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = arrays.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


class _Node:
    __slots__ = ("depth", "start", "words", "first", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, start: int, words: int, first: bool):
        self.depth, self.start, self.words, self.first = depth, start, words, first
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.waiting: list[tuple] = []  # closed children, until this node's smallest member is known


def _prefix_digests(key: bytes) -> list[bytes]:
    """What names each prefix of a conversation."""
    running, out = hashlib.sha256(), []
    out.append(running.digest())
    for at in range(0, len(key), SYMBOL):
        running.update(key[at : at + SYMBOL])
        out.append(running.copy().digest())
    return out


def _common(a: bytes, b: bytes) -> int:
    """Turns that two conversations begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // SYMBOL
    differs = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differs.argmax()) // SYMBOL


class _Sweep:
    """The stack of one range partition."""

    def __init__(self, part: int):
        self.part, self.rows, self.stack, self.out = part, 0, [], []
        self.first = self.last = b""

    def add(self, conv_id: int, key: bytes, words: list[int]) -> None:
        shared = _common(self.last, key) if self.rows else -1
        while len(self.stack) - 1 > shared:
            self._pop(at_end=False)
        for depth in range(len(self.stack), len(words) + 1):
            self.stack.append(_Node(depth, self.rows, words[depth - 1] if depth else 0, first=not self.rows))
        if not self.rows:
            self.digests = _prefix_digests(key)
        top = self.stack[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ends.append(conv_id)
        self.last = key
        self.rows += 1

    def finish(self) -> None:
        if self.rows:
            self.last_digests = _prefix_digests(self.last)
            while self.stack:
                self._pop(at_end=True)

    def _pop(self, at_end: bool) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if parent is not None:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
        ends = ",".join(map(str, node.ends))
        if node.first or at_end:
            side, digests = (0, self.digests) if node.first else (1, self.last_digests)
            digest, above = digests[node.depth], digests[node.depth - 1] if node.depth else None
            self.out.append((PIECE, self.part, side, node.depth, node.start, digest, above, node.least, None, node.n, node.children, node.leaves, node.saved, node.words, None))
            if node.ends:
                self.out.append((ENDS, self.part, side, node.depth, None, digest, None, None, None, None, None, None, None, None, ends))
            # Where the parent's smallest member isn't known yet, part, side and depth say whose child this is.
            self.out += [(NODE, self.part, side, *x[3:8], None, *x[9:]) for x in node.waiting]
            return
        saved = node.saved + (node.n - 1) * node.words
        leaves = node.leaves if node.children else 1
        self.out += [(*x[:8], node.least, *x[9:]) for x in node.waiting]
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        ended = hashlib.sha256(ends.encode()).hexdigest()
        parent.waiting.append((NODE, self.part, None, node.depth, None, None, None, node.least, None, node.n, node.children, leaves, saved, None, ended))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, key, words`` in order -> ``SWEPT``."""
    sweep = _Sweep(TaskContext.get().partitionId())
    for batch in batches:
        for conv_id, key, words in zip(*(c.to_pylist() for c in batch.columns)):
            sweep.add(conv_id, key, words)
        yield from _batches(sweep.out, 5000)
    sweep.finish()
    yield from _batches(sweep.out)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes, merged and each before those below it -> the same with what their subtrees sum to."""
    stack: list[dict[str, Any]] = []
    out: list[tuple] = []

    def pop() -> None:
        node = stack.pop()
        leaves = node["n_leaves"] if node["n_children"] else 1
        saved = node["saved_tokens"] + (node["n_convs"] - 1) * node["words"]
        above = stack[-1] if stack else None
        if above:
            above["n_leaves"] += leaves
            above["saved_tokens"] += saved
        parent = above["conv_id"] if above else None
        out.append((PIECE, None, None, node["depth"], None, node["digest"], None, node["conv_id"], parent, node["n_convs"], node["n_children"], leaves, saved, None, None))

    for batch in batches:
        for node in batch.to_pylist():
            while stack and stack[-1]["depth"] >= node["depth"]:
                pop()
            if stack:
                stack[-1]["n_children"] += 1
            stack.append(node)
        yield from _batches(out, 5000)
    while stack:
        pop()
    yield from _batches(out)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``digest, part, ends`` in order -> ``digest, ends_sha256``: a running hash, whatever the number of ids."""
    now, running = None, None
    for batch in batches:
        out = []
        for digest, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if digest != now:
                if running is not None:
                    out.append((now, running.hexdigest()))
                now, running = digest, hashlib.sha256(ends.encode())
            else:
                running.update(f",{ends}".encode())
        yield _hashes(out)
    if running is not None:
        yield _hashes([(now, running.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["digest", "ends_sha256"])


def prefix_trie(arrays: DataFrame, turns_per_task: int = TURNS_PER_TASK) -> DataFrame:
    """``conv_id, turns`` (see :func:`turn_arrays`; one row an id) -> one row a node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.  A node is a distinct sequence of first
    turns, the root the empty one; conversations that begin with it are its members, those
    without turns of the root alone.  ``saved_tokens`` sums, over the node's subtree, each node's
    members less one times the words of its last turn.  ``ends_sha256`` hashes the ids that end
    at the node, ascending and comma-joined.

    An empty table gives an empty result.  A conversation is one row of 32 bytes a turn, so it
    must fit in a task; copies of one conversation are split by id.  A task holds its
    range's nodes at most.  The hash of the ids of one node is a running one over a
    partition's ids a row: the order makes it sequential.
    """
    spark = arrays.sparkSession
    small_batches(spark)
    n_turns = arrays.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_turns // turns_per_task))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    keyed = arrays.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    ranged = keyed.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = settle(ranged.mapInArrow(_sweep, SWEPT), "swept")

    pieces = swept.filter(F.col("kind") == PIECE)
    merged = pieces.groupBy("digest", "depth").agg(
        F.min(F.struct("part", "start")).alias("at"),
        *[F.min(c).alias(c) for c in ("conv_id", "words")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    in_order = merged.coalesce(1).sortWithinPartitions("at", "depth")
    open_ = settle(in_order.mapInArrow(_stitch, SWEPT), "open-nodes")
    chunks = swept.filter(F.col("kind") == ENDS).select("digest", "part", "ends")
    ended = chunks.repartition("digest").sortWithinPartitions("digest", "part").mapInArrow(_hash_ends, "digest binary, ends_sha256 string")
    nothing = hashlib.sha256(b"").hexdigest()
    open_nodes = open_.drop("ends").join(ended, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))

    # Children of open nodes: each partition's own slots, so that the root's many children aren't one key.
    slots = pieces.select("part", "side", F.col("depth").alias("above"), "digest").join(open_.select("digest", F.col("conv_id").alias("of")), "digest").drop("digest")
    closed = swept.filter(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256")
    settled = closed.filter("side is null")
    hanging = closed.filter("side is not null").drop("parent_conv_id").withColumn("above", F.col("depth") - 1).join(slots, ["part", "side", "above"]).withColumnRenamed("of", "parent_conv_id")
    long = [F.col(c).cast("long").alias(c) if c != "ends_sha256" else F.col(c) for c in COLUMNS]
    return settled.select(*long).unionByName(hanging.select(*long)).unionByName(open_nodes.select(*long))


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 4, turns_per_task: int = TURNS_PER_TASK) -> DataFrame:
    """The trie of conversations whose heads are shared; see :func:`share_heads` and :func:`prefix_trie`.

    Rows that repeat are turns of their own; other columns aren't read, whatever their names; texts
    of any length are hashed where they lie.
    """
    arrays = settle(turn_arrays(conversations), "turn-arrays")
    return prefix_trie(settle(share_heads(arrays, every, most), "rebuilt"), turns_per_task)
