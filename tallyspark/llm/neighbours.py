"""Approximate nearest neighbours by cosine, with randomly rotated one-bit codes.

Every vector is centred, turned by a random rotation and reduced to the signs of its
components, packed into bits, with two scalars: its distance from the centre and how well
the signs stand for it.  Codes and scalars alone meet the queries: a query's turned
components are quantised to a few bits, so that its inner product with all codes is a count
of common bits a bit plane.  From it the cosine follows with an error bound; only vectors
whose bound reaches the best ones found in their block are ranked by their original components,
in the same task, so what is possible is never written down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.blocks import BLOCK, best, blocks_of, dealt, every, matrix, one_row_an_id, query_groups, same_length, vectors
from tallyspark.llm.common import settle
from tallyspark.sources.shared import discard

#: Standard deviations of the error bound.
EPSILON = 2.6
#: Vectors nearest by their codes, of a block, that say where a query's bar is.
FIRST = 128
#: Bits of a query's component.
QUERY_BITS = 4
SEED = 17
#: Components of a block at most: its original vectors are doubles in a task.
CELLS = 8_000_000

FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, packed into 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(unit: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors -> packed signs, distance from the centre, and the signs' inner product with the direction."""
    off = unit - centre
    length = np.linalg.norm(off, axis=1)
    turned = (off / np.maximum(length, 1e-12)[:, None]) @ turn
    fit = np.abs(turned).sum(1) / np.sqrt(unit.shape[1])
    return _words(turned > 0), length, fit


def index(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """``vec_id, v`` -> ``vec_id, v, code, length, fit``: the code of every vector, beside it."""
    turn = rotation(len(centre))
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            words, length, fit = encode(v / np.linalg.norm(v, axis=1)[:, None], centre, turn)
            coded = [pa.array([w.tobytes() for w in words], pa.binary()), pa.array(length), pa.array(fit)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *coded], ["vec_id", "v", "code", "length", "fit"])

    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id long, v {kind}, code binary, length double, fit double")


def mean_direction(rows: DataFrame, dim: int) -> np.ndarray:
    """The mean of all vectors' directions: sums a partition, in billionths, so that their order doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, np.int64)
        for batch in batches:
            v = np.array(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, dim)
            n += len(v)
            total += np.rint(v / np.linalg.norm(v, axis=1)[:, None] * 1e9).astype(np.int64).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total), pa.array(np.full(dim, n))], ["at", "total", "n"])

    sums = rows.select("v").mapInArrow(run, "at int, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return np.array([r["total"] / max(r["n"], 1) / 1e9 for r in sums.orderBy("at").collect()])


class Codes:
    """The codes of a block, as words and scalars."""

    def __init__(self, code: list[bytes], length: np.ndarray, fit: np.ndarray, centre: np.ndarray):
        self.words = np.ascontiguousarray(np.frombuffer(b"".join(code), np.uint64).reshape(len(code), -1).T)
        self.ones = np.bitwise_count(self.words).sum(0, dtype=np.int64)
        self.length, self.fit, self.centre = length, np.maximum(fit, 1e-6), centre
        self.turn = rotation(len(centre))
        self.spread = EPSILON * length / self.fit

    def common_bits(self, planes: np.ndarray) -> np.ndarray:
        """The inner product of each code with a query's quantised components."""
        total = np.zeros(self.words.shape[1], np.int64)
        for bit, plane in enumerate(planes):
            for word, mine in zip(plane, self.words):
                total += np.bitwise_count(mine & word).astype(np.int64) << bit
        return total

    def estimate(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cosine of a unit query with every vector of the block, and how far off it may be."""
        dim = len(unit)
        turned = unit @ self.turn
        low, step = turned.min(), max((turned.max() - turned.min()) / ((1 << QUERY_BITS) - 1), 1e-12)
        level = np.rint((turned - low) / step).astype(np.int64)
        planes = _words((level >> np.arange(QUERY_BITS)[:, None]) & 1)
        total = low * dim + step * level.sum()
        signs = (2 * (low * self.ones + step * self.common_bits(planes)) - total) / np.sqrt(dim)
        # <unit query, unit vector> = <query, centre> + length * <query, direction>
        guess = unit @ self.centre + self.length / self.fit * signs
        # What the signs don't see of the query, and the rounding of its components.
        unseen = np.sqrt(np.maximum(1 - self.fit**2, 0) / max(dim - 1, 1) + step**2 / 12)
        return guess, self.spread * unseen


def norms(b: np.ndarray) -> np.ndarray:
    return np.sqrt((b * b).sum(1))


def cosine(a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """Of one vector and the rows of a matrix (and their :func:`norms`), from the original components."""
    return (b * a).sum(1) / (of_b * np.sqrt((a * a).sum()))


def _search(k: int, centre: np.ndarray):
    """Codes and original vectors of a block, and queries -> of each query the block's nearest."""

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            ids, v = rows["vec_id"].to_numpy(np.int64), matrix(rows["v"])
            length = norms(v)
            codes = Codes(rows["code"].tolist(), rows["length"].to_numpy(), rows["fit"].to_numpy(), centre)
            for q_id, q in zip(queries["vec_id"], queries["v"]):
                q = np.asarray(q, np.float64)
                guess, slack = codes.estimate(q / np.linalg.norm(q))
                guess[ids == q_id] = -np.inf
                # True cosines of the nearest by their codes set the bar.
                first = np.argpartition(guess, -FIRST)[-FIRST:] if len(guess) > FIRST else np.arange(len(guess))
                first = first[ids[first] != q_id]
                known = cosine(q, v[first], length[first])
                near = guess + slack >= (np.partition(known, -k)[-k] if len(known) >= k else -np.inf)
                near[first] = True
                at = np.flatnonzero(near & (ids != q_id))
                score = cosine(q, v[at], length[at])
                order = np.lexsort((ids[at], -score))[:k]
                out.append((np.full(len(order), q_id), ids[at][order], score[order]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns))).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def in_range(rows: DataFrame) -> DataFrame:
    """Very large and very small vectors of doubles, by a power of two nearer to 1."""
    if rows.schema["v"].dataType.elementType.typeName() != "double":
        return rows
    most = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    scale = F.pow(F.lit(2.0), -F.greatest(F.floor(F.log2(most)), F.lit(-1000)))
    far = (most > 0) & ~most.between(1e-100, 1e100)
    return rows.withColumn("v", F.when(far, F.transform("v", lambda x: x * scale)).otherwise(F.col("v")))


def nearest(table: DataFrame, k: int = 5, every_nth: int = 50, block: int = BLOCK) -> DataFrame:
    """``vec_id, embedding`` -> ``query_id, rank, vec_id, score`` for ids divisible by ``every_nth``.

    Null and zero vectors, and those with a null or non-finite component, take no part, nor do
    rows without an id; shorter vectors are continued by zeros.  Rows with the query's id aren't
    its neighbours; of rows that repeat it the smallest vector is the query.  Ties go to the
    smaller id; an empty table gives an empty result.  Other columns aren't read.  The centre is
    the mean of all vectors' directions.

    Codes and original vectors travel once for each group of queries; a task reranks those of its block that a
    query's bound leaves possible, and hands on ``k`` a query.  Vectors whose squares
    would leave the range of doubles are scaled by a power of two, which no cosine feels.
    """
    rows = in_range(vectors(table))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows, dim = same_length(rows.filter((norm > 0) & (norm < float("inf"))))
    if not dim:
        return best(rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")), k)
    rows = settle(rows, "vectors")
    centre = mean_direction(rows, dim)
    indexed = settle(index(rows, centre), "index")
    discard(rows)
    queries = settle(one_row_an_id(indexed.filter(F.col("vec_id") % every_nth == 0).select("vec_id", "v")), "queries")
    blocks = blocks_of(indexed, max(1, min(block, CELLS // dim)))
    groups = query_groups(queries, blocks)
    left = indexed.withColumn("block", dealt("vec_id", blocks, 1)).withColumn("part", every(groups))
    right = queries.withColumn("part", dealt("vec_id", groups, 2)).withColumn("block", every(blocks))
    hits = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_search(k, centre), FOUND)
    return best(hits, k)
