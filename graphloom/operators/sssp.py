"""Single- or multi-source shortest paths: synchronous relaxation of what changed last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import INFINITE, Graph
from graphloom.plans.fixpoint import Epoch, iterate
from graphloom.plans.strategies import Strategy, deliver, flood, meet, strategy


def relax_epoch(
    graph: Graph,
    state: DataFrame,
    rows: int | None = None,
    how: str | Strategy = "broadcast",
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """One relaxation of (id, dist, fresh): edges out of fresh vertices into [start, end).

    ``fresh`` in the result marks what became smaller. One shuffle, of messages and state, and
    another of the fresh rows where they are too many to broadcast.
    """
    how = strategy(how)
    fresh = state.filter("fresh").select("id", "dist")
    sent = deliver(graph, fresh, rows, how, F.col("dist") + F.col("w"), F.min, "new", start, end)
    return _lowered(meet(state.select("id", "dist"), sent, F.min, "new"))


def _lowered(both: DataFrame) -> DataFrame:
    smaller = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
    best = F.when(smaller, F.col("new")).otherwise(F.col("dist"))
    return both.select("id", best.alias("dist"), smaller.alias("fresh"))


def sssp(
    graph: Graph,
    source: int | DataFrame,
    how: str | Strategy = "broadcast",
    max_epochs: int = 1 << 20,
    complete: bool = False,
    trace: list[Epoch] | None = None,
) -> DataFrame:
    """(id, dist) of the reached vertices.

    ``source`` is a vertex, or an initial table (id, dist): any starting distances are lowered
    to the fixpoint. Weights must not be negative. ``complete`` adds the others with infinity.
    """
    if not graph.weighted:
        raise ValueError("shortest paths need a weight column w")
    if graph.prepared.filter("w < 0").take(1):
        raise ValueError("weights must not be negative")
    if isinstance(source, DataFrame):
        start = source.filter(F.col("dist") < INFINITE).groupBy("id").agg(F.min("dist").cast("double").alias("dist"))
    else:
        start = graph.vertices.filter(F.col("id") == source).distinct().withColumn("dist", F.lit(0.0))
    start = start.withColumn("fresh", F.lit(True))

    def step(state: DataFrame, _: int, known: dict) -> DataFrame:
        if not known:
            return _lowered(flood(graph, state, F.col("dist") + F.col("w"), F.min, "new"))
        return relax_epoch(graph, state, int(known["updated"]), how)

    rows = start.count() if isinstance(source, DataFrame) else 1
    state, epochs = iterate(
        start,
        step,
        {"updated": F.count_if("fresh")},
        max_epochs,
        {"updated": rows},
        lambda known: known["updated"] == 0,
        "updated" if how in ("plain", "broadcast") else None,
    )
    if trace is not None:
        trace += epochs
    out = state.select("id", "dist")
    if complete:
        out = graph.vertices.join(out, "id", "left").select("id", F.coalesce("dist", F.lit(INFINITE)).alias("dist"))
    return out


def dijkstra(edges: list[tuple[int, int, float]], source: int) -> dict[int, float]:
    """Distances by a heap on the driver: a check for small graphs in tests."""
    import heapq

    out: dict[int, list[tuple[int, float]]] = {}
    for s, d, w in edges:
        out.setdefault(s, []).append((d, w))
    done: dict[int, float] = {}
    heap = [(0.0, source)]
    while heap:
        dist, node = heapq.heappop(heap)
        if node not in done:
            done[node] = dist
            for d, w in out.get(node, ()):
                if d not in done:
                    heapq.heappush(heap, (dist + w, d))
    return done
