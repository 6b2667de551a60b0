"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.storage import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v; the result is again such edges, without repeats.

    The least neighbour comes from a map-side combined ``min`` and is joined back, so no
    vertex's neighbours are ever gathered into one list; the adaptive skew join splits hubs.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.filter("u > v").unionAll(least.select("u", F.col("m").alias("v")))
    return moved.distinct()


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the least node reachable.

    Empty links give no rows. Each round ends in a reliable checkpoint, and stops once a round
    leaves the edges as they were; rounds grow with the logarithm of a component's size.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
