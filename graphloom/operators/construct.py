"""Graph construction: symmetrise, deduplicate, degrees, prefix sums, relabel, CSR views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import Graph

#: Ids in a block of the two-level scans; a block is sorted in one task.
SCAN_BLOCK = 1 << 20


def max_id(edges: DataFrame) -> DataFrame:
    """One row (max_id): the greatest id at either end; null without edges."""
    return edges.agg(F.greatest(F.max("src"), F.max("dst")).alias("max_id"))


def end_points(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def dense_vertices(edges: DataFrame) -> DataFrame:
    """All ids from 0 to the greatest, isolated ones too."""
    top = max_id(edges).first()[0]
    return edges.sparkSession.range(0 if top is None else top + 1)


def reversed_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every entry and its reverse, with the same weight; ``edges`` is read once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = F.struct("src", "dst", *rest)
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.select(F.inline(F.array(there, back)))


def symmetrize_missing(edges: DataFrame) -> DataFrame:
    """Distinct entries without loops, and the reverses that are missing (unweighted)."""
    base = squish(edges.select("src", "dst"))
    missing = reversed_edges(base).join(base, ["src", "dst"], "left_anti")
    return base.unionByName(missing)


def squish(edges: DataFrame) -> DataFrame:
    """No loops, and one entry for each (src, dst): the one of least weight."""
    rest = [F.min("w").alias("w")] if "w" in edges.columns else []
    proper = edges.filter("src <> dst")
    return proper.groupBy("src", "dst").agg(*rest) if rest else proper.select("src", "dst").distinct()


def degrees(edges: DataFrame, transpose: bool = False) -> DataFrame:
    """(id, degree) of vertices that have entries: out-degree, or in-degree if ``transpose``."""
    return edges.groupBy(F.col("dst" if transpose else "src").alias("id")).agg(F.count("*").alias("degree"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src = dst").select(F.col("src").alias("id")).distinct()


def has_self_loop(edges: DataFrame, node: int) -> bool:
    return bool(edges.filter((F.col("src") == node) & (F.col("dst") == node)).take(1))


def neighbors(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("src") == node).drop("src").orderBy("dst")


def degree_of(edges: DataFrame, node: int) -> int:
    return edges.filter(F.col("src") == node).count()


def prefix_sum(df: DataFrame, key: str, value: str, out: str, block: int = SCAN_BLOCK) -> DataFrame:
    """``df`` and the sum of ``value`` over all smaller ``key``; keys are distinct integers.

    Two levels: sums of blocks of ids, a scan over the few block sums, and a scan inside each
    block. No window ever covers the whole table.
    """
    blocked = df.withColumn("_block", F.floor(F.col(key) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return blocked.withColumn("_own", own).join(sums, "_block").withColumn(out, F.col("_base") + F.col("_own")).drop("_block", "_own", "_base")


def csr_index(graph: Graph) -> DataFrame:
    """(id, offset, degree): where each vertex's entries start in (src, dst) order."""
    return prefix_sum(graph.degrees, "id", "degree", "offset").select("id", "offset", "degree")


def adjacency(graph: Graph) -> DataFrame:
    """(id, offset, degree, nbrs): the CSR rows, neighbours sorted by id.

    A view for export and inspection of graphs whose longest row fits a task; no algorithm here
    builds it.
    """
    entry = F.struct(F.col("dst").alias("v"), *(["w"] if graph.weighted else []))
    rows = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("nbrs"))
    kind = "array<struct<v:bigint,w:double>>" if graph.weighted else "array<struct<v:bigint>>"
    return csr_index(graph).join(rows, "id", "left").withColumn("nbrs", F.coalesce("nbrs", F.expr(f"cast(array() as {kind})")))


def degree_ranks(degrees_: DataFrame, block: int = SCAN_BLOCK) -> DataFrame:
    """(id, degree, rank) from 0 by falling (degree, id).

    Counts of (degree, block of ids) are scanned first; then each such cell is ranked alone, so
    the many vertices of a common degree are spread over tasks.
    """
    cells = degrees_.withColumn("_block", F.floor(F.col("id") / block))
    before = Window.orderBy(F.desc("degree"), F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    counts = cells.groupBy("degree", "_block").agg(F.count("*").alias("_n"))
    counts = counts.select("degree", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("degree", "_block").orderBy(F.desc("id"))
    ranked = cells.withColumn("_own", F.row_number().over(inside) - 1).join(counts, ["degree", "_block"])
    return ranked.select("id", "degree", (F.col("_base") + F.col("_own")).cast("long").alias("rank"))


def relabel(graph: Graph, names: DataFrame) -> Graph:
    """``graph`` with each id replaced by that of ``names`` (id, new)."""
    rest = ["w"] if graph.weighted else []
    out = graph.edges.join(names.select(F.col("id").alias("src"), F.col("new").alias("_s")), "src")
    out = out.join(names.select(F.col("id").alias("dst"), F.col("new").alias("_d")), "dst")
    vertices = graph.vertices.join(names, "id").select(F.col("new").alias("id"))
    return Graph(out.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest), vertices, graph.symmetric)


def relabel_by_degree(graph: Graph) -> Graph:
    """Ids renumbered by falling degree, of equal degrees the larger old id first."""
    if not graph.symmetric:
        raise ValueError("only a symmetric graph can be relabelled by degree")
    return relabel(graph, degree_ranks(graph.degrees).select("id", F.col("rank").alias("new")))


def permute_ids(edges: DataFrame, num_nodes: int, seed: int) -> DataFrame:
    """Both ends renamed by one random permutation of 0 to ``num_nodes`` - 1.

    A Feistel network on the ids' bits: a bijection computed from each id alone, where a table
    of ranks would cost a global sort and two joins.
    """
    from graphloom.functions.random import permute_columns

    return permute_columns(edges, ["src", "dst"], num_nodes, seed)


def subgraph(graph: Graph, start: int, end: int) -> DataFrame:
    """(id, offset, degree) of ids in [start, end), offsets from 0 at its first row."""
    part = csr_index(graph).filter((F.col("id") >= start) & (F.col("id") < end))
    first = part.agg(F.min("offset").alias("_first"))
    return part.join(F.broadcast(first)).select("id", (F.col("offset") - F.col("_first")).alias("offset"), "degree")


def subgraph_edges(graph: Graph, start: int, end: int) -> DataFrame:
    return graph.edges.filter((F.col("src") >= start) & (F.col("src") < end))


def in_range(column: str, start: int | None, end: int | None) -> Column:
    """Whether ``column`` is in [start, end); an open side is None."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= start)
    if end is not None:
        out = out & (F.col(column) < end)
    return out
