"""Breadth-first search: push, pull and direction-optimising, level by level.

The parent of a vertex is the least id among its neighbours one level up, which every direction
and strategy gives alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import UNREACHED, Graph
from graphloom.operators.construct import in_range
from graphloom.plans.fixpoint import Epoch, iterate
from graphloom.plans.strategies import SegmentPlan, Strategy, combine, deliver, flood, meet, strategy

DIRECTIONS = ("push", "pull")
#: Fixed values of the direction rule: divisors of the edges left to check and of the vertices.
ALPHA, BETA = 15, 18


def push_epoch(graph: Graph, visited: DataFrame, frontier: DataFrame, rows: int | None = None, how: str | Strategy = "broadcast") -> DataFrame:
    """(id, parent) of the vertices that the frontier's out-edges newly reach."""
    seen = visited.select("id", F.lit(True).alias("seen"))
    return _pushed(graph, seen, frontier, rows, how).filter("seen is null").select("id", F.col("via").alias("parent"))


def _pushed(graph: Graph, state: DataFrame, frontier: DataFrame, rows: int | None, how: str | Strategy) -> DataFrame:
    """``state`` and new rows, with the least frontier neighbour as ``via``."""
    return meet(state, deliver(graph, frontier.select("id"), rows, strategy(how), F.col("src"), F.min, "via"), F.min, "via")


def pull_epoch(
    graph: Graph,
    visited: DataFrame,
    frontier: DataFrame,
    rows: int | None = None,
    how: str | Strategy = "broadcast",
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """(id, parent) of the unvisited vertices in [start, end) with an in-edge from the frontier.

    Edges lie by target, so unvisited ones are found and combined where they are; only the
    frontier moves, to every task if it is small enough. ``partial_agg`` reduces for each (target,
    part of the sources) first; ``salted`` deals the in-edges of hubs over tasks.
    """
    how = strategy(how)
    if isinstance(how, SegmentPlan):
        raise ValueError("a pull step takes its range as start and end")
    seen, keys = visited.select(F.col("id").alias("dst")), ["dst"]
    if how.name == "salted":
        edges, hubs = graph.salted_by_target(how.hub_degree, how.salts)
        copies = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(how.salts - 1))).otherwise(F.array(F.lit(0)))
        seen, keys = seen.join(hubs, "dst", "left").select("dst", F.explode(copies).alias("_salt")), ["dst", "_salt"]
    else:
        edges = graph.prepared_by_target
    open_ = edges.filter(in_range("dst", start, end)).join(seen, keys, "left_anti")
    sources = frontier.select(F.col("id").alias("src"))
    if how.name == "broadcast" and rows is not None and rows <= how.broadcast_rows:
        sources = F.broadcast(sources)
    hit = open_.join(sources, "src", "left_semi")
    if how.name in ("salted", "partial_agg"):
        part = F.col("_salt") if how.name == "salted" else F.pmod(F.hash("src"), F.lit(how.salts))
        hit = hit.groupBy("dst", part.alias("_part")).agg(F.min("src").alias("src"))
    return combine(hit.select(F.col("dst").alias("id"), F.col("src").alias("parent")), F.min, "parent")


class DirectionRule:
    """Push or pull for each level, from the counts of the level before."""

    def __init__(self, num_nodes: int, num_edges: int, alpha: int = ALPHA, beta: int = BETA):
        self.num_nodes, self.to_check, self.alpha, self.beta = num_nodes, num_edges, alpha, beta
        self.pulling, self.before = False, 0

    def next(self, rows: int, out_edges: int) -> str:
        """The direction for a frontier of ``rows`` vertices with ``out_edges`` edges."""
        if self.pulling:
            self.pulling = rows > self.before or rows > self.num_nodes // self.beta
            if not self.pulling:
                out_edges = 1
        if not self.pulling:
            if out_edges > self.to_check // self.alpha:
                self.pulling = True
            else:
                self.to_check -= out_edges
        self.before = rows
        return DIRECTIONS[self.pulling]


def bfs(
    graph: Graph,
    source: int,
    direction: str | Sequence[str] = "push",
    how: str | Strategy = "broadcast",
    max_levels: int = 1 << 20,
    complete: bool = False,
    trace: list[Epoch] | None = None,
) -> DataFrame:
    """(id, parent, depth) of the vertices reached from ``source``; the source is its own parent.

    ``direction`` is push, pull, auto (the direction rule), or a plan: one of the two for each
    level, the last for all after. ``complete`` adds unreached vertices with -1. A source that
    is no vertex reaches nothing. ``trace`` gets each level's counts.
    """
    if isinstance(direction, str) and direction not in (*DIRECTIONS, "auto"):
        raise ValueError(f"no direction {direction!r}")
    if not isinstance(direction, str) and (not direction or any(d not in DIRECTIONS for d in direction)):
        raise ValueError("a direction plan names push or pull for each level")
    rule = DirectionRule(graph.num_nodes, graph.num_edges) if direction == "auto" else None
    start = graph.vertices.filter(F.col("id") == source).distinct()
    start = start.select("id", F.col("id").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("fresh"))
    degrees = graph.degrees if rule else None

    pushing = direction == "push" and how in ("plain", "broadcast")

    def step(state: DataFrame, level: int, known: dict) -> DataFrame:
        if not known:
            both = flood(graph, state, F.col("src"), F.min, "via")
            depth = F.when(F.col("depth").isNull(), F.lit(level + 1).cast("long")).otherwise(F.col("depth"))
            return both.select("id", F.coalesce("parent", "via").alias("parent"), depth.alias("depth"), F.col("depth").isNull().alias("fresh"))
        rows = int(known["rows"])
        if rule:
            way = rule.next(rows, int(known["out_edges"] or 0))
        else:
            way = direction if isinstance(direction, str) else direction[min(level, len(direction) - 1)]
        frontier, depth = state.filter("fresh"), F.lit(level + 1).cast("long")
        if way == "push":
            new = F.col("depth").isNull()
            both = _pushed(graph, state.select("id", "parent", "depth"), frontier, rows, how)
            both = both.select("id", F.coalesce("parent", "via").alias("parent"), F.coalesce("depth", depth).alias("depth"), new.alias("fresh"))
        else:
            found = pull_epoch(graph, state, frontier, rows, how).select("id", "parent", depth.alias("depth"), F.lit(True).alias("fresh"))
            both = state.select("id", "parent", "depth", F.lit(False).alias("fresh")).unionAll(found)
            both = both.coalesce(graph.partitions)  # a union adds up partitions, level after level
        if rule is None:
            return both
        weights = degrees.withColumnRenamed("id", "src")
        return both.join(weights, F.col("fresh") & (F.col("id") == F.col("src")), "left").drop("src")

    metrics = {"rows": F.count_if("fresh")}
    first: dict[str, object] = {"rows": 1}
    if rule:
        start = start.join(degrees, "id", "left")
        metrics["out_edges"] = F.sum("degree")
        first["out_edges"] = start.agg(F.sum("degree")).first()[0] or 0
    state, epochs = iterate(start, step, metrics, max_levels, first, lambda k: k["rows"] == 0, "rows" if pushing else None)
    if trace is not None:
        trace += epochs
    out = state.select("id", "parent", "depth")
    if complete:
        fill = lambda c: F.coalesce(c, F.lit(UNREACHED)).cast("long").alias(c)
        out = graph.vertices.join(out, "id", "left").select("id", fill("parent"), fill("depth"))
    return out


def levels(result: DataFrame) -> DataFrame:
    """(depth, vertices) of a search's result."""
    return result.filter("depth >= 0").groupBy("depth").agg(F.count("*").alias("vertices"))


def k_hop(graph: Graph, source: int, hops: int) -> DataFrame:
    """(id, depth) of the vertices within ``hops`` of ``source``."""
    return bfs(graph, source, max_levels=hops).select("id", "depth")
