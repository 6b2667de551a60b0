"""Equal-edge segments of the id range, their statistics, and source picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.random import uniform
from graphloom.model import Graph
from graphloom.operators.construct import csr_index

SEED = 37525


def segment_of(graph: Graph, segments: int) -> DataFrame:
    """(id, offset, degree, segment): every vertex in exactly one of ``segments`` ranges.

    A vertex belongs to the segment in which the edges before it end, so that each has about
    E / ``segments`` edges; fewer and longer ones where single vertices have more.
    """
    if segments < 1:
        raise ValueError("there must be a segment")
    total = graph.num_edges
    index = csr_index(graph)
    number = F.lit(0) if total == 0 else F.least(F.lit(segments - 1), F.floor(F.col("offset") * segments / F.lit(total)))
    return index.withColumn("segment", number.cast("long"))


def equal_edge_ranges(graph: Graph, segments: int, chunk: int = 1) -> DataFrame:
    """(segment, start_id, end_id): ranges [start, end) that cover the ids without gaps.

    Inner bounds are rounded to the nearest multiple of ``chunk``, halves up. A segment that no
    vertex falls into is an empty range.
    """
    firsts = segment_of(graph, segments).groupBy("segment").agg(F.min("id").alias("first"))
    stop = graph.vertices.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("stop"))
    # From here on there is one row for each segment.
    numbers = graph.spark.range(segments).select(F.col("id").alias("segment"))
    order = Window.orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, 0)
    starts = numbers.join(firsts, "segment", "left").join(F.broadcast(stop))
    start = F.when(F.col("segment") == 0, F.lit(0)).otherwise(F.coalesce(F.last("first", ignorenulls=True).over(order), F.col("stop")))
    starts = starts.select("segment", "stop", start.alias("raw"))
    rest = F.col("raw") % chunk
    near = F.col("raw") - rest + F.when((rest > 0) & (rest * 2 >= chunk), chunk).otherwise(0)
    inner = F.when(F.col("segment") == 0, F.lit(0)).otherwise(F.least(near, F.col("stop")))
    starts = starts.select("segment", "stop", inner.cast("long").alias("start_id"))
    after = Window.orderBy("segment")
    return starts.select("segment", "start_id", F.coalesce(F.lead("start_id").over(after), F.col("stop")).cast("long").alias("end_id"))


def segment_stats(graph: Graph, segments: int) -> DataFrame:
    """(segment, start_id, end_id, vertices, num_edges, avg_degree, min_degree, max_degree) of segments with vertices."""
    rows = segment_of(graph, segments).groupBy("segment")
    return rows.agg(
        F.min("id").alias("start_id"),
        (F.max("id") + 1).alias("end_id"),
        F.count("*").alias("vertices"),
        F.sum("degree").alias("num_edges"),
        (F.sum("degree") / F.count("*")).alias("avg_degree"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
    )


def eligible_sources(graph: Graph) -> DataFrame:
    """(id) of the vertices with an edge to another one."""
    return graph.edges.filter("src <> dst").select(F.col("src").alias("id")).distinct()


class SourcePicker:
    """Eligible vertices in a seeded random order, or one constant source."""

    def __init__(self, graph: Graph, constant: int | None = None, seed: int = SEED):
        self.graph, self.constant, self.seed, self.drawn = graph, constant, seed, 0

    def next(self) -> int:
        """The next vertex; the order starts anew after the last. ValueError if none is eligible."""
        return self.take(1)[0]

    def take(self, n: int) -> list[int]:
        if self.constant is not None:
            return [self.constant] * n
        # The order's first rows by a distributed top-k; n is the number of runs of a benchmark.
        order = eligible_sources(self.graph).orderBy(uniform(self.seed, F.col("id")), "id")
        rows = [r.id for r in order.limit(self.drawn + n).collect()]
        if not rows:
            raise ValueError("no vertex has an edge to another one")
        picked = [rows[i % len(rows)] for i in range(self.drawn, self.drawn + n)]
        self.drawn += n
        return picked

    def reset(self) -> None:
        self.drawn = 0
