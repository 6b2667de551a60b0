"""Ways to send values along edges and to combine what arrives: one operator, several plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph

STRATEGIES = ("plain", "partial_agg", "salted", "broadcast")

#: Rows of a side that may be broadcast: of two 8-byte columns, some 16 MB.
BROADCAST_ROWS = 1_000_000
#: Out-degree from which a vertex's edges are dealt to several tasks, and to how many.
HUB_DEGREE, SALTS = 1_000_000, 16


@dataclass(frozen=True)
class Strategy:
    """``name`` of STRATEGIES and its limits.

    plain        join on the source, aggregate by target
    partial_agg  the same with a combine before the shuffle that is not left to chance: values
                 are first reduced for each (target, partition of the source)
    salted       the edges of hub sources are dealt over ``salts`` tasks, with as many copies of
                 the hubs' values; targets are combined in two steps
    broadcast    values go to every task, if they are at most ``broadcast_rows``; else plain
    """

    name: str = "broadcast"
    broadcast_rows: int = BROADCAST_ROWS
    hub_degree: int = HUB_DEGREE
    salts: int = SALTS

    def __post_init__(self):
        if self.name not in STRATEGIES:
            raise ValueError(f"no strategy {self.name!r}; there are {STRATEGIES}")


@dataclass(frozen=True)
class SegmentPlan:
    """A strategy for each range [start, end) of target ids: (start, end, strategy) rows."""

    ranges: tuple[tuple[int | None, int | None, Strategy], ...]

    @classmethod
    def of(cls, rows) -> SegmentPlan:
        """From (start, end, name or Strategy) rows, which must not overlap."""
        ranges = sorted(((a, b, strategy(s)) for a, b, s in rows), key=lambda r: (r[0] is not None, r[0] or 0))
        for (_, stop, _), (start, _, _) in zip(ranges, ranges[1:], strict=False):
            if stop is None or start is None or start < stop:
                raise ValueError("ranges of a segment plan overlap")
        return cls(tuple(ranges))


def strategy(choice):
    """A Strategy or SegmentPlan as it is, or the strategy of a name."""
    return choice if isinstance(choice, (Strategy, SegmentPlan)) else Strategy(choice)


def send(graph: Graph, values: DataFrame, rows: int | None, how: Strategy, start: int | None = None, end: int | None = None) -> DataFrame:
    """Edges whose source is in ``values`` (id, ...), with its columns; targets in [start, end).

    ``rows`` is the number of ``values`` if it is known.
    """
    from graphloom.operators.construct import in_range

    edges, values = graph.prepared, values.withColumnRenamed("id", "src")
    if how.name == "salted":
        edges, hubs = graph.salted(how.hub_degree, how.salts)
    if start is not None or end is not None:
        edges = edges.filter(in_range("dst", start, end))
    if how.name == "salted":
        copies = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(how.salts - 1))).otherwise(F.array(F.lit(0)))
        values = values.join(hubs, "src", "left").withColumn("_salt", F.explode(copies)).drop("_hub")
        return edges.join(values, ["src", "_salt"]).drop("_salt")
    if how.name == "broadcast" and rows is not None and rows <= how.broadcast_rows:
        values = F.broadcast(values)
    return edges.join(values, "src")


def deliver(
    graph: Graph,
    values: DataFrame,
    rows: int | None,
    how: Strategy | SegmentPlan,
    message: Column,
    reduce,
    name: str,
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """(id, name) rows: the ``message`` of every edge from ``values``, or partial reductions of them.

    ``meet`` or ``combine`` finishes them. With a segment plan each range runs by its own
    strategy and one union has all of them.
    """
    if isinstance(how, SegmentPlan):
        parts = []
        for a, b, own in how.ranges:
            low = a if start is None else start if a is None else max(a, start)
            high = b if end is None else end if b is None else min(b, end)
            if low is None or high is None or low < high:
                parts.append(deliver(graph, values, rows, own, message, reduce, name, low, high))
        if not parts:
            return deliver(graph, values, rows, Strategy("plain"), message, reduce, name, 0, 0)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out
    sent = send(graph, values, rows, how, start, end).select("src", F.col("dst").alias("id"), message.alias(name))
    if how.name in ("salted", "partial_agg"):
        part = F.pmod(F.hash("src"), F.lit(how.salts))
        sent = sent.groupBy("id", part.alias("_part")).agg(reduce(name).alias(name))
    return sent.select("id", name)


def combine(messages: DataFrame, reduce, name: str) -> DataFrame:
    """(id, name): one row for each target."""
    return messages.groupBy("id").agg(reduce(name).alias(name))


def meet(state: DataFrame, messages: DataFrame, reduce, name: str) -> DataFrame:
    """``state`` and ``name``, the reduction of the messages to each id; a row for each id in either.

    A union and one aggregation in place of an aggregation and an outer join: messages and
    state are combined where they are and cross one shuffle, which nothing has to sort.
    """
    rest = [c for c in state.columns if c != "id"]
    kind = messages.schema[name].dataType
    mine = state.select("id", *rest, F.lit(None).cast(kind).alias(name))
    theirs = messages.select("id", *[F.lit(None).cast(state.schema[c].dataType).alias(c) for c in rest], name)
    return mine.unionAll(theirs).groupBy("id").agg(*[F.max(c).alias(c) for c in rest], reduce(name).alias(name))


def flood(graph: Graph, state: DataFrame, message: Column, reduce, name: str) -> DataFrame:
    """``meet`` of ``state`` (id, ..., fresh) and the messages along edges out of fresh rows, by the plain strategy.

    The state is used once: each joined edge carries its source's row along, which the aggregation
    puts together again. So several epochs make one plan that does not double with each, and as
    state and edges lie by hash of the id, one shuffle is all that an epoch needs.
    """
    rest = [c for c in state.columns if c not in ("id", "fresh")]
    edges = graph.prepared
    sent = state.join(edges, (F.col("id") == F.col("src")) & F.col("fresh"), "left").withColumn(name, message)
    kind = sent.schema[name].dataType
    mine = F.struct("id", *rest, F.lit(None).cast(kind).alias(name))
    theirs = F.struct(F.col("dst").alias("id"), *[F.lit(None).cast(state.schema[c].dataType).alias(c) for c in rest], name)
    rows = sent.select(F.inline(F.when(F.col("dst").isNull(), F.array(mine)).otherwise(F.array(mine, theirs))))
    return rows.groupBy("id").agg(*[F.max(c).alias(c) for c in rest], reduce(name).alias(name))
