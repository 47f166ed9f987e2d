"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import settle


def connected_components(links: DataFrame) -> DataFrame:
    """``a, b`` (long, linked) -> ``node, root``: the smallest node reachable.

    Only nodes that have a link to another node are returned.  Each round is a grouping
    and a join per star, and the links are written between rounds; nothing of a node's
    neighbourhood is gathered in one place, so a node of very many links is as good as
    any other.  The number of rounds is about the logarithm of the longest path.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = settle(edges, "links")
    seen = None
    while True:
        # Large star: a node links its larger neighbours to its smallest one.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node links its smaller neighbours and itself to the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select("a", "b", "m")
        edges = settle(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small_least.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct(),
            "links",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = now
