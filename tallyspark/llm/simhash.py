"""Near-duplicate detection: SimHash fingerprints, linked with the help of a vantage-point tree.

The tree splits the 64-bit Hamming space by distance to vantage points.  A fingerprint
has one home shard; where it lies inside a ball and within the radius of its edge it is
sent across as well, so by the triangle inequality every linked pair meets in some shard.
Shards link their fingerprints exactly and hand on a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.llm.common import settle, small_batches
from tallyspark.llm.components import connected_components

RADIUS, SHINGLE = 3, 3
#: Distinct fingerprints that a shard may hold in any case, and that are compared one by one.
SHARD, BRUTE = 2_000, 4_000
#: A shard may hold one in so many of all fingerprints.  How often a fingerprint is sent then depends on how they lie and
#: not on how many there are; a large shard splits itself, in its task's memory.
PARTS = 12
#: Fingerprints the driver fits the tree on, at most.
SAMPLE = 100_000
#: The sample is one in so many fingerprints, or fewer.
LEAST_STEP = 8
#: Vantage points tried at each node.
TRIES = 12


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles as an unsigned integer; 0 if it has no word.

    Words are split at ASCII white space after lower-casing A-Z; fewer words than ``width``
    are one shingle.  Shingles count as often as they occur.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = ends[min(width, len(words)) - 1 :] - 1
    first = np.concatenate([[0], ends[: len(last) - 1]])
    digest, seed = xxhash.xxh64_digest, 42
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), 100_000):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + 100_000].tolist(), last[at : at + 100_000].tolist())])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``doc_id, text`` -> the columns ``keep`` and ``fp``; the 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    taken = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text) for text in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found.view(np.int64))], [*keep, "fp"])

    schema = StructType([taken.schema[c] for c in keep])
    return taken.mapInArrow(run, schema.add("fp", "long"))


class VantageTree:
    """Nodes as arrays: vantage point, cut, and the children inside and outside; leaves are shards."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int = RADIUS):
        self.radius, self.shards = radius, 0
        self.vantage: list[int] = []
        self.cut: list[int] = []
        self.children: list[list[int]] = []  # shard s is written as -1 - s
        self.root = self._grow(sample, leaf, np.random.default_rng(7))

    def _grow(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        best = None
        if len(points) > leaf:
            for v in rng.choice(points, min(TRIES, len(points)), replace=False):
                at_distance = np.bincount(np.bitwise_count(points ^ v), minlength=65)
                inside = np.cumsum(at_distance)
                crossing = inside - np.concatenate([np.zeros(self.radius, np.int64), inside[: -self.radius]])
                # Rows after the split, in the larger side: what a cut must bring down.
                larger = np.maximum(inside, len(points) - inside + crossing)
                cut = int(np.argmin(larger + crossing))
                if larger[cut] < 0.9 * len(points) and (best is None or larger[cut] + crossing[cut] < best[0]):
                    best = (larger[cut] + crossing[cut], v, cut)
        if best is None:
            self.shards += 1
            return -self.shards
        node = len(self.vantage)
        self.vantage.append(int(best[1]))
        self.cut.append(best[2])
        self.children.append([0, 0])
        distance = np.bitwise_count(points ^ best[1])
        self.children[node][0] = self._grow(points[distance <= best[2]], leaf, rng)
        self.children[node][1] = self._grow(points[distance > best[2] - self.radius], leaf, rng)
        return node

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard with the positions of the points that go there."""
        open_ = [(self.root, np.arange(len(points)))]
        while open_:
            node, at = open_.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at
                continue
            distance = np.bitwise_count(points[at] ^ np.uint64(self.vantage[node])).astype(np.int64)
            open_.append((self.children[node][0], at[distance <= self.cut[node]]))
            # Home is outside, or inside but within the radius of the edge.
            open_.append((self.children[node][1], at[distance > self.cut[node] - self.radius]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the links a-b; a label is the smallest position of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        low = np.minimum(x[apart], y[apart])
        np.minimum.at(label, x[apart], low)
        np.minimum.at(label, y[apart], low)
        while not np.array_equal(up := label[label], label):
            label = up


def link_shard(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct sorted points, the position of the smallest one in the same component."""
    label = np.arange(len(points))
    tree = VantageTree(points, BRUTE, radius) if len(points) > 2 * BRUTE else None
    for _, at in tree.route(points) if tree else [(0, label.copy())]:
        part = points[at]
        here = np.arange(len(part))
        for i in range(0, len(part), 256):
            near = np.bitwise_count(part[i : i + 256, None] ^ part[None, i:]) <= radius
            x, y = np.nonzero(near)
            keep = x < y
            if keep.any():
                here = _merge(here, i + x[keep], i + y[keep])
        moved = np.flatnonzero(here != np.arange(len(part)))
        if len(moved):
            label = _merge(label, at[moved], at[here[moved]])
    return label


def link(points: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Written rows of distinct ``fp`` -> the same with ``root``, the smallest ``fp`` of the component.

    The tree is fitted on one in ``LEAST_STEP`` of the distinct fingerprints and on at most
    ``sample``; every fingerprint is routed through it and compared.  A shard holds ``shard`` of them,
    or one in ``PARTS`` of all where that is more, so the rows sent grow as the fingerprints do.
    """
    n = points.count()
    step = max(LEAST_STEP, -(-n // (sample // 2)))
    taken = points.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).limit(sample).toPandas()
    drawn = np.sort(taken["fp"].to_numpy(np.int64).view(np.uint64)) if len(taken) else np.empty(0, np.uint64)
    tree = VantageTree(drawn, max(1, shard // step, len(drawn) // PARTS), radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = batch.column(0).to_numpy(zero_copy_only=False)
            for number, at in tree.route(here.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(here[at])], ["shard", "fp"])

    def link_part(part: pd.DataFrame) -> pd.DataFrame:
        here = np.unique(part["fp"].to_numpy(np.int64).view(np.uint64))
        label = link_shard(here, radius)
        moved = label != np.arange(len(here))
        return pd.DataFrame({"a": here[moved].view(np.int64), "b": here[label[moved]].view(np.int64)})

    links = points.select("fp").mapInArrow(route, "shard int, fp long").groupBy("shard").applyInPandas(link_part, "a long, b long")
    roots = connected_components(links)
    return points.join(roots, points["fp"] == roots["node"], "left").select(*points.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, fingerprint, component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; a component
    carries its smallest doc_id.  Texts without a word (null, empty) share fingerprint zero,
    which links like any other.  Equal fingerprints are one point of the tree, so groups of
    copies cost one point.  Repeated rows get a row each; a null doc_id is never a component's
    smallest unless all are null; texts of any length are read whole; other columns aren't read,
    whatever their names; an empty table gives an empty result.
    """
    marks = settle(fingerprints(docs), "fingerprints")
    points = settle(marks.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "points")
    rooted = link(points, radius, shard, sample)
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_point = rooted.join(first, "root").select(F.col("fp").alias("point"), "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marks.join(of_point, marks["fp"] == of_point["point"]).select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` (``doc_id`` and ``text`` among them) of one row of each component.

    The row with the smallest doc_id stays, one without doc_id only where all are.  Rows are
    told apart by a number written beside them, as ids can be null or repeated.  Null and empty
    texts are one component; texts of any length are read whole; only ``columns`` are handed on.
    """
    hashed = fingerprints(docs, columns).withColumn("_hash", F.xxhash64("text"))
    marks = settle(hashed.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "fp", F.col("_hash").alias("hash"), F.col("_row").alias("row"))
    points = settle(marks.groupBy("fp").agg(F.min(place).alias("place")), "points")
    first = link(points).groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row").alias("first_row"))
    return marks.join(first, marks["_row"] == first["first_row"]).select(*columns)
