"""PageRank by synchronous epochs, with the rule that small changes are not stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.plans.fixpoint import Epoch, iterate
from graphloom.plans.strategies import Strategy, deliver, meet, strategy

DAMPING, TOLERANCE, MAX_EPOCHS = 0.85, 5e-8, 201


def rank_epoch(
    graph: Graph,
    state: DataFrame,
    damping: float = DAMPING,
    tol: float = TOLERANCE,
    freeze: bool = True,
    how: str | Strategy = "plain",
    rows: int | None = None,
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """One epoch of (id, degree, score): ``moved`` marks changes over ``tol``.

    With ``freeze`` only such changes are stored. Vertices outside [start, end) keep theirs.
    Messages carry score / degree, so degrees never travel.
    """
    from graphloom.operators.construct import in_range

    how = strategy(how)
    share = state.filter("degree > 0").select("id", (F.col("score") / F.col("degree")).alias("share"))
    sent = deliver(graph, share, rows, how, F.col("share"), F.sum, "got", start, end)
    base = (1 - damping) / max(graph.num_nodes, 1)
    new = F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
    both = meet(state.select("id", "degree", "score"), sent, F.sum, "got").filter("score is not null")
    both = both.withColumn("new", F.when(in_range("id", start, end), new).otherwise(F.col("score")))
    moved = F.abs(F.col("new") - F.col("score")) > tol
    score = F.when(moved, F.col("new")).otherwise(F.col("score")) if freeze else F.col("new")
    return both.select("id", "degree", score.alias("score"), moved.alias("moved"))


def pagerank(
    graph: Graph,
    damping: float = DAMPING,
    tol: float = TOLERANCE,
    max_epochs: int = MAX_EPOCHS,
    freeze: bool = True,
    how: str | Strategy = "plain",
    init: DataFrame | None = None,
    trace: list[Epoch] | None = None,
) -> DataFrame:
    """(id, score): until no vertex moves by more than ``tol``, or ``max_epochs``.

    Scores start at 1/N, or at ``init`` (id, score). Nothing is passed on for vertices without
    edges. Out-degrees count entries.
    """
    base = 1.0 / graph.num_nodes if graph.num_nodes else 0.0
    start = graph.degrees
    if init is not None:
        start = start.join(init.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(base)))
    else:
        start = start.withColumn("score", F.lit(base))
    start = start.select("id", "degree", "score", F.lit(True).alias("moved"))
    state, epochs = iterate(
        start,
        lambda state, _, known: rank_epoch(graph, state, damping, tol, freeze, how, graph.num_nodes),
        {"updated": F.count_if("moved")},
        max_epochs,
        {},
        lambda known: known["updated"] == 0,
    )
    if trace is not None:
        trace += epochs
    return state.select("id", "score")
