"""Verification: counts of violations, which are all zero for a right result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import INFINITE, UNREACHED, Graph


def verify_bfs(graph: Graph, source: int, result: DataFrame, depths: DataFrame) -> DataFrame:
    """One row of counts over the vertices, for (id, parent) against true (id, depth).

    wrong_reach   reached in one of the two only
    wrong_source  the source's parent is not itself
    wrong_depth   not one level below the parent
    not_an_edge   the parent has no edge to it
    """
    parents = result.select("id", F.when(F.col("parent") != UNREACHED, F.col("parent")).alias("parent"))
    true = depths.filter("depth >= 0").select("id", "depth")
    rows = graph.vertices.join(parents, "id", "left").join(true, "id", "left")
    up = true.select(F.col("id").alias("parent"), F.col("depth").alias("up"))
    rows = rows.join(up, "parent", "left")
    links = graph.edges.select(F.col("src").alias("parent"), F.col("dst").alias("id"), F.lit(True).alias("linked")).distinct()
    rows = rows.join(links, ["parent", "id"], "left")
    other = (F.col("id") != source) & F.col("parent").isNotNull()
    return rows.agg(
        F.count_if(F.col("parent").isNull() != F.col("depth").isNull()).alias("wrong_reach"),
        F.count_if((F.col("id") == source) & ~F.col("parent").eqNullSafe(F.col("id"))).alias("wrong_source"),
        F.count_if(other & ~(F.col("depth")).eqNullSafe(F.col("up") + 1)).alias("wrong_depth"),
        F.count_if(other & F.col("linked").isNull()).alias("not_an_edge"),
    )


def _values(df: DataFrame, column: str, name: str) -> DataFrame:
    value = F.col(column)
    return df.select("id", F.when(value != INFINITE, value).alias(name))


def differences(result: DataFrame, expected: DataFrame, column: str = "dist") -> DataFrame:
    """(id, got, want) where the two differ exactly; infinite and missing are alike."""
    both = _values(result, column, "got").join(_values(expected, column, "want"), "id", "full_outer")
    return both.filter(~F.col("got").eqNullSafe(F.col("want")))


def verify_sssp(result: DataFrame, expected: DataFrame) -> DataFrame:
    return differences(result, expected).agg(F.count("*").alias("wrong_dist"))


def first_errors(errors: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows by id, for a report."""
    return errors.orderBy("id").limit(n)


def verify_pagerank(result: DataFrame, expected: DataFrame, rel_tol: float = 1e-4, abs_tol: float = 1e-12) -> DataFrame:
    """Counts scores that differ by more than a share of the expected one, or are missing."""
    both = result.select("id", F.col("score").alias("got")).join(expected.select("id", F.col("score").alias("want")), "id", "full_outer")
    near = F.abs(F.col("got") - F.col("want")) <= F.greatest(F.abs("want") * rel_tol, F.lit(abs_tol))
    return both.agg(F.count_if(~F.coalesce(near, F.lit(False))).alias("wrong_score"))


def verify_same_graph(one: Graph, two: Graph) -> DataFrame:
    """Counts of vertices and entries (with weights) that only one of the two has."""
    count = lambda a, b: a.exceptAll(b).agg(F.count("*").alias("n"))
    columns = one.edges.columns
    nodes = count(one.vertices, two.vertices).unionAll(count(two.vertices, one.vertices)).agg(F.sum("n").alias("wrong_vertices"))
    entries = count(one.edges, two.edges.select(columns)).unionAll(count(two.edges.select(columns), one.edges))
    return nodes.join(F.broadcast(entries.agg(F.sum("n").alias("wrong_edges"))))
