"""A query set against all vectors, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block, and queries that meet it in one task, at most.
BLOCK, QUERIES = 50_000, 100_000
#: Queries below which a group isn't split to give every core a task.
LEAST_QUERIES = 128


def finite(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def vectors(table: DataFrame) -> DataFrame:
    """``vec_id, v``: the rows that take part."""
    taken = table.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    return taken.filter(F.col("vec_id").isNotNull() & finite(F.col("v")) & (F.size("v") > 0))


def same_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """Shorter vectors end in zeros, which change neither products nor lengths; and the length (0: no row)."""
    dim, kind = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0, rows.schema["v"].dataType.elementType
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(kind), F.lit(dim) - F.size("v")))), dim


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def dealt(key: str, parts: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)).cast("int")


def blocks_of(rows: DataFrame, block: int) -> int:
    return max(1, -(-rows.count() // block))


def query_groups(queries: DataFrame, blocks: int, tasks_a_core: int = 1, at_most: int = QUERIES) -> int:
    """Groups of queries: each block of vectors travels once for each, so there are few.

    Enough to give every core ``tasks_a_core`` tasks, none above ``at_most`` queries.
    """
    n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    spread = min(-(-tasks_a_core * cores // blocks), n // LEAST_QUERIES)
    return max(1, spread, -(-n // at_most))


def every(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller vec_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """Queries are ids: of rows that repeat one, the smallest vector is the query."""
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))
