"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = cut(down.groupBy("u").agg(F.min("v").alias("m")), "low")
    near = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of one ordered type -> ``(node, root)``; root is the least node of the component.

    The least neighbours are written before they are joined: so both sides of the join are shuffles of
    known size, and the edges of a hub are broadcast to or split over tasks.

    Only nodes with an edge to another node come back; self loops and repeated edges are ignored.
    Each round keeps at most one edge per input edge, and only a count and a checksum reach the
    driver. The rounds grow with the logarithm of the largest component.
    """
    now = cut(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)), "star")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(seen)
    raise RuntimeError("components did not settle")
