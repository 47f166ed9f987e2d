"""Exact top-k by integer inner product over an impact-ordered index.

Each component is quantised to floor(256 x).  The index is a table of posting segments: for a
block of vectors, a dimension and a level of impact (the component's size) the vectors and
their components.  A query takes a block's segments by descending product of their greatest
impact with its own component and adds their postings to the scores, score at a time.  What
is still missing of a vector is at most its postings left times the next segment's product;
once that proves that only few vectors can be among the best, these are rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.blocks import BLOCK, best, blocks_of, dealt, every, matrix, one_row_an_id, query_groups, same_length, vectors
from tallyspark.llm.common import settle

#: Levels of impact in a block.
LEVELS = 8
#: A query stops once at most this share of the block's vectors is possible.
FEW = 0.01
#: Shares of a block's postings after which a query looks whether it may stop.
LOOKS = (0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 1.0)

SEGMENT = "block int, dim int, top long, ids binary, values binary"
#: The count of a vector's added postings stands in the low bits of its score.
COUNT_BITS = 16


def segments(values: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Integer vectors -> ``dim, top, at, values``: postings by dimension and level of impact."""
    size = np.abs(values)
    width = max(1, -(-int(size.max(initial=0)) // LEVELS))
    out = []
    for dim in range(values.shape[1]):
        at = np.flatnonzero(values[:, dim])
        level = size[at, dim] // width
        order = np.argsort(-level, kind="stable")
        cuts = np.flatnonzero(np.diff(level[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                out.append((dim, int(size[at[part], dim].max()), at[part], values[at[part], dim]))
    return out


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's ``block, vec_id, v`` -> its segments; the row of dimension -1 holds the ids."""
    rows = rows.sort_values("vec_id", kind="stable")
    block, values = int(rows["block"].iloc[0]), matrix(rows["v"]).astype(np.int64)
    out = [(block, -1, 0, rows["vec_id"].to_numpy(np.int64).tobytes(), b"")]
    out += [(block, dim, top, at.astype(np.int32).tobytes(), part.tobytes()) for dim, top, at, part in segments(values)]
    return pd.DataFrame(out, columns=["block", "dim", "top", "ids", "values"])


class ImpactIndex:
    """A block's posting segments, and its vectors put together from them."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray, np.ndarray]], n: int, dims: int):
        self.parts, self.n = parts, n
        self.dim = np.array([p[0] for p in parts], np.int64)
        self.top = np.array([p[1] for p in parts], np.float64)
        self.size = np.array([len(p[2]) for p in parts], np.int64)
        self.values = np.zeros((n, dims), np.int64)
        self.postings = np.zeros(n, np.int64)
        for dim, _, at, values in parts:
            self.values[at, dim] = values
            self.postings[at] += 1
        self.touched = 0

    def possible(self, query: np.ndarray, k: int) -> np.ndarray:
        """Positions of all vectors that can be among the query's ``k`` best."""
        product = self.top * np.abs(query[self.dim]) if len(self.parts) else np.zeros(0)
        if self.n <= k or product.max(initial=0.0) * len(query) >= 2.0**46 or len(query) >= 1 << COUNT_BITS:
            return np.arange(self.n)
        order = np.argsort(-product, kind="stable")
        order = order[product[order] > 0]
        done = np.cumsum(self.size[order])
        score = np.zeros(self.n, np.int64)
        weight = query << COUNT_BITS
        start = 0
        for share in LOOKS:
            end = int(np.searchsorted(done, share * done[-1])) + 1 if len(done) else 0
            for s in order[start:end]:
                dim, _, at, values = self.parts[s]
                score[at] += values * weight[dim] + 1
                self.touched += len(at)
            start = max(start, end)
            left = product[order[start]] if start < len(order) else 0.0
            added = score & ((1 << COUNT_BITS) - 1)
            slack = (self.postings - added) * left
            total = (score >> COUNT_BITS).astype(np.float64)
            low = total - slack
            members = np.flatnonzero(total + slack >= np.partition(low, -k)[-k])
            if start >= len(order) or len(members) <= max(8 * k, FEW * self.n):
                return members
        return members


def _search(k: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            ids = np.frombuffer(index.loc[index["dim"] < 0, "ids"].iloc[0], np.int64)
            index = index[index["dim"] >= 0]
            q_ids, q = queries["vec_id"].to_numpy(), matrix(queries["v"]).astype(np.int64)
            parts = [(d, t, np.frombuffer(i, np.int32).astype(np.intp), np.frombuffer(v, np.int64)) for d, t, i, v in zip(index["dim"], index["top"], index["ids"], index["values"])]
            block = ImpactIndex(parts, len(ids), q.shape[1])
            for q_id, query in zip(q_ids, q):
                # A query's own rows are no results of it: look for as many more.
                own = np.searchsorted(ids, q_id, "right") - np.searchsorted(ids, q_id)
                near = block.possible(query, k + int(own))
                near = near[ids[near] != q_id]
                score = block.values[near] @ query
                order = np.lexsort((ids[near], -score))[:k]
                out.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[near][order], "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return search


def top_k(table: DataFrame, k: int = 5, every_nth: int = 50, block: int = BLOCK) -> DataFrame:
    """``vec_id, embedding`` -> ``query_id, rank, vec_id, score`` for ids divisible by ``every_nth``.

    Null vectors and those with a null or non-finite component take no part, nor do rows
    without an id; shorter vectors are continued by zeros.  A zero vector scores 0.  Rows with
    the query's id aren't its results; of rows that repeat it the smallest vector is the query.
    Ties go to the smaller id; an empty table gives an empty result.  Other columns aren't read.
    """
    rows, dim = same_length(vectors(table))
    if not dim:
        return best(rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")), k)
    rows = settle(rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * 256.0).cast("double")).alias("v")), "quantised")
    queries = one_row_an_id(rows.filter(F.col("vec_id") % every_nth == 0))
    blocks = blocks_of(rows, block)
    index = settle(rows.withColumn("block", dealt("vec_id", blocks, 1)).groupBy("block").applyInPandas(_index, SEGMENT), "postings")
    groups = query_groups(queries, blocks, tasks_a_core=2)
    left = index.withColumn("part", every(groups))
    right = queries.withColumn("part", dealt("vec_id", groups, 2)).withColumn("block", every(blocks))
    hits = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    return best(hits, k)
