"""The graph operators as queries over the driver's tables, with DuckDB SQL for each.

Graphs come from line items: parts have even ids and suppliers odd ones, an edge's weight is the
least price of its pair. G1 has all items and is shallow and dense, G2 few and is deep.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import benchmarks
from graphloom.functions.reductions import reduce_all, reduce_groups, salted_reduce
from graphloom.model import Graph
from graphloom.operators import bfs as search
from graphloom.operators import construct, segments, verify
from graphloom.operators.pagerank import pagerank, rank_epoch
from graphloom.operators.sssp import relax_epoch, sssp
from graphloom.functions.random import permute_columns
from graphloom.plans import schedule
from graphloom.plans.storage import ensure_checkpoint_dir
from graphloom.plans.strategies import Strategy
from graphloom.sources import generate
from graphloom.sources.csr import load_csr, write_csr
from graphloom.sources.profiles import parse_kernel, read_profiles, read_schedule, to_yaml, write_schedule

RULES = {"G1": "true", "G2": "l_linenumber = 1 and l_quantity <= 3"}
Query = Callable[[SparkSession, str], DataFrame]
_GRAPHS: dict[tuple[str, str, str], Graph] = {}


def raw_edges(spark: SparkSession, sf_dir: str, name: str = "G1") -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter(RULES[name])
    return items.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.col("l_extendedprice").alias("w"))


def graph(spark: SparkSession, sf_dir: str, name: str = "G1") -> Graph:
    """The fixture graph, built once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _GRAPHS:
        _GRAPHS[key] = Graph.from_edges(raw_edges(spark, sf_dir, name))
    return _GRAPHS[key]


def source(g: Graph) -> int:
    """The vertex of greatest degree, of equal ones the least id."""
    return g.degrees.orderBy(F.desc("degree"), "id").first().id


def _edges_sql(name: str) -> str:
    return f"""raw AS (SELECT 2 * l_partkey AS a, 2 * l_suppkey + 1 AS b, l_extendedprice AS w FROM lineitem WHERE {RULES[name]}),
pairs AS (SELECT a, b, min(w) AS w FROM raw GROUP BY a, b),
e AS (SELECT a AS src, b AS dst, w FROM pairs UNION ALL SELECT b, a, w FROM pairs),
deg AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src),
source AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1)"""


def _with(name: str, rest: str, recursive: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_edges_sql(name)}{', ' + recursive if recursive else ''} {rest}"


_BFS = """b(id, depth) USING KEY (id) AS (
  SELECT id, 0::BIGINT FROM source
  UNION SELECT e.dst, min(b.depth + 1) FROM b JOIN e ON b.id = e.src LEFT JOIN recurring.b r ON r.id = e.dst WHERE r.id IS NULL GROUP BY e.dst)"""
_SSSP = """d(id, dist) USING KEY (id) AS (
  SELECT id, 0.0::DOUBLE FROM {start}
  UNION SELECT e.dst, min(d.dist + e.w) FROM d JOIN e ON d.id = e.src LEFT JOIN recurring.d r ON r.id = e.dst
  WHERE r.dist IS NULL OR d.dist + e.w < r.dist GROUP BY e.dst)"""
_PARENTS = """SELECT b.id, CASE WHEN b.depth = 0 THEN b.id ELSE min(p.id) END AS parent, b.depth
FROM b LEFT JOIN e ON e.dst = b.id LEFT JOIN b p ON p.id = e.src AND p.depth = b.depth - 1 GROUP BY b.id, b.depth"""
_BLOCK = "sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_INDEX = f"idx AS (SELECT id, coalesce({_BLOCK}, 0)::BIGINT AS o, degree FROM deg)"


def _segments_sql(k: int) -> str:
    return f"{_INDEX}, seg AS (SELECT id, o, degree, least({k - 1}, floor(o * {k} / (SELECT sum(degree) FROM deg)))::BIGINT AS segment FROM idx)"


def _ranks_sql(epochs: int, tol: float = -1.0) -> str:
    n, parts = "(SELECT count(*) FROM deg)", ["r0 AS (SELECT id, degree, 1.0 / (SELECT count(*) FROM deg) AS score FROM deg)"]
    for k in range(1, epochs + 1):
        new = f"(1 - 0.85) / {n} + 0.85 * coalesce(g.got, 0)"
        parts.append(
            f"r{k} AS (SELECT s.id, s.degree, CASE WHEN abs({new} - s.score) > {tol} THEN {new} ELSE s.score END AS score FROM r{k - 1} s "
            f"LEFT JOIN (SELECT e.dst AS id, sum(x.score / x.degree) AS got FROM e JOIN r{k - 1} x ON x.id = e.src GROUP BY e.dst) g ON g.id = s.id)"
        )
    return ", ".join(parts)


#: A small profile: (device, kernel, segment, millis).
PROFILE = [
    (d, k, s, float(m))
    for d, k, times in (
        ("CPU A", "sssp plain", (9, 8, 7, 6, 5, 4)),
        ("CPU A", "sssp salted", (10, 8, 9, 3, 6, 4)),
        ("NVIDIA B", "sssp partial_agg 64 1024", (4, 5, 6, 7, 8, 9)),
        ("NVIDIA B", "sssp broadcast 256 256", (5, 4, 6, 9, 7, 8)),
    )
    for s, m in enumerate(times)
]
COUNTS = {"CPU A": 1, "NVIDIA B": 2}
_PROFILE_SQL = "p(device, kernel, segment, millis) AS (VALUES {})".format(", ".join(f"('{d}', '{k}', {s}, {m}::DOUBLE)" for d, k, s, m in PROFILE))
_BEST_SQL = f"WITH {_PROFILE_SQL}, best AS (SELECT device, segment, arg_min(kernel, (millis, kernel)) AS kernel, min(millis) AS millis FROM p GROUP BY device, segment)"


def profile(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILE, schedule.PROFILE_SCHEMA)


def _lanes(spark: SparkSession) -> DataFrame:
    lanes = schedule.most_gain(schedule.costs(profile(spark)), COUNTS)
    return spark.createDataFrame(schedule.to_rows(lanes), schedule.SCHEDULE_SCHEMA)


#: A hub here has this many edges, which some vertices of G1 reach at every size.
SALTED = Strategy("salted", hub_degree=100)

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


# Construction


@query("edges_symmetrized", _with("G1", "SELECT a AS src, b AS dst, w FROM raw UNION ALL SELECT b, a, w FROM raw"))
def edges_symmetrized(spark, sf_dir):
    return construct.symmetrize(raw_edges(spark, sf_dir))


@query("edges_squished", _with("G1", "SELECT src, dst, w FROM e"))
def edges_squished(spark, sf_dir):
    return construct.squish(construct.symmetrize(raw_edges(spark, sf_dir)))


@query("edges_missing_inverses", _with("G1", "SELECT src, dst FROM e"))
def edges_missing_inverses(spark, sf_dir):
    return construct.symmetrize_missing(raw_edges(spark, sf_dir))


@query("edges_unweighted", _with("G1", "SELECT src, dst FROM e"))
def edges_unweighted(spark, sf_dir):
    return graph(spark, sf_dir).unweighted().edges


@query("max_node_id", _with("G1", "SELECT greatest(max(src), max(dst)) AS max_id FROM e"))
def max_node_id(spark, sf_dir):
    return construct.max_id(graph(spark, sf_dir).edges)


@query("degrees", _with("G1", "SELECT id, degree FROM deg"))
def degrees(spark, sf_dir):
    return construct.degrees(graph(spark, sf_dir).edges)


@query("degrees_in", _with("G2", "SELECT b AS id, count(*) AS degree FROM raw GROUP BY b"))
def degrees_in(spark, sf_dir):
    return construct.degrees(raw_edges(spark, sf_dir, "G2"), transpose=True)


@query("degree_histogram", _with("G1", "SELECT degree, count(*) AS vertices FROM deg GROUP BY degree"))
def degree_histogram(spark, sf_dir):
    return graph(spark, sf_dir).degrees.groupBy("degree").agg(F.count("*").alias("vertices"))


@query("csr_index", _with("G1", f"SELECT id, coalesce({_BLOCK}, 0)::BIGINT AS \"offset\", degree FROM deg"))
def csr_index(spark, sf_dir):
    return construct.csr_index(graph(spark, sf_dir))


@query("adjacency_first_last", _with("G1", "SELECT src AS id, count(*) AS degree, min(dst) AS first_nbr, max(dst) AS last_nbr, sum(dst)::BIGINT AS sum_nbr FROM e GROUP BY src"))
def adjacency_first_last(spark, sf_dir):
    rows = construct.adjacency(graph(spark, sf_dir))
    total = F.aggregate("nbrs", F.lit(0).cast("long"), lambda a, x: a + x["v"])
    return rows.select("id", "degree", F.get("nbrs", F.lit(0))["v"].alias("first_nbr"), F.element_at("nbrs", -1)["v"].alias("last_nbr"), total.alias("sum_nbr"))


@query("neighbors_of_source", _with("G1", "SELECT dst, w FROM e WHERE src = (SELECT id FROM source)"))
def neighbors_of_source(spark, sf_dir):
    g = graph(spark, sf_dir)
    return construct.neighbors(g.edges, source(g))


@query("self_loops", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey % 100 = o_orderkey % 100")
def self_loops(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dst = F.when(F.col("o_custkey") % 100 == F.col("o_orderkey") % 100, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1)
    return construct.self_loops(orders.select(F.col("o_custkey").alias("src"), dst.alias("dst")))


@query(
    "relabel_by_degree",
    _with(
        "G1",
        """, rk AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id DESC) - 1 AS new FROM deg)
SELECT s.new AS src, d.new AS dst, e.w FROM e JOIN rk s ON s.id = e.src JOIN rk d ON d.id = e.dst""",
    ).replace(" , rk", ", rk"),
)
def relabel_by_degree(spark, sf_dir):
    return graph(spark, sf_dir).ordered().edges.select("src", "dst", "w")


@query("degree_ranks", _with("G1", "SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id DESC) - 1 AS rank FROM deg"))
def degree_ranks(spark, sf_dir):
    return construct.degree_ranks(graph(spark, sf_dir).degrees)


@query("subgraph_range", _with("G1", f", {_INDEX}, part AS (SELECT * FROM idx WHERE id >= 100 AND id < 400) SELECT id, o - (SELECT min(o) FROM part) AS \"offset\", degree FROM part").replace(" , idx", ", idx"))
def subgraph_range(spark, sf_dir):
    return construct.subgraph(graph(spark, sf_dir), 100, 400)


@query("source_eligible", _with("G2", "SELECT DISTINCT src AS id FROM e WHERE src <> dst"))
def source_eligible(spark, sf_dir):
    return segments.eligible_sources(graph(spark, sf_dir, "G2"))


@query("source_picks")
def source_picks(spark, sf_dir):
    picks = segments.SourcePicker(graph(spark, sf_dir, "G2")).take(8)
    return spark.createDataFrame([(i, p) for i, p in enumerate(picks)], "draw int, id long")


@query("segment_of_vertex", _with("G1", f", {_segments_sql(24)} SELECT id, o AS \"offset\", degree, segment FROM seg").replace(" , idx", ", idx"))
def segment_of_vertex(spark, sf_dir):
    return segments.segment_of(graph(spark, sf_dir), 24)


@query(
    "equal_edge_segments",
    _with(
        "G1",
        f""", {_segments_sql(24)}, s0 AS (SELECT k.segment, CASE WHEN k.segment = 0 THEN 0 ELSE
  coalesce((SELECT min(id) FROM seg WHERE seg.segment >= k.segment), (SELECT max(id) + 1 FROM deg)) END AS raw FROM (SELECT unnest(range(24)) AS segment) k),
s1 AS (SELECT segment, CASE WHEN segment = 0 THEN 0 ELSE least(raw - raw % 8 + CASE WHEN raw % 8 >= 4 THEN 8 ELSE 0 END, (SELECT max(id) + 1 FROM deg)) END AS start_id FROM s0)
SELECT segment, start_id, coalesce(lead(start_id) OVER (ORDER BY segment), (SELECT max(id) + 1 FROM deg)) AS end_id FROM s1""",
    ).replace(" , idx", ", idx"),
)
def equal_edge_segments(spark, sf_dir):
    return segments.equal_edge_ranges(graph(spark, sf_dir), 24, chunk=8)


@query(
    "segment_stats",
    _with(
        "G1",
        f""", {_segments_sql(24)} SELECT segment, min(id) AS start_id, max(id) + 1 AS end_id, count(*) AS vertices, sum(degree)::BIGINT AS num_edges,
  sum(degree) / count(*) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM seg GROUP BY segment""",
    ).replace(" , idx", ", idx"),
)
def segment_stats(spark, sf_dir):
    return segments.segment_stats(graph(spark, sf_dir), 24)


# Search


def _bfs_query(name: str, g: str, sql: str, columns: list[str], **options) -> None:
    @query(name, _with(g, sql, _BFS))
    def run(spark, sf_dir):
        own = graph(spark, sf_dir, g)
        return search.bfs(own, source(own), **options).select(*columns)


_bfs_query("bfs_depth", "G1", "SELECT id, depth FROM b", ["id", "depth"])
_bfs_query("bfs_parent", "G1", _PARENTS, ["id", "parent", "depth"])
_bfs_query("bfs_parent_deep", "G2", _PARENTS, ["id", "parent", "depth"])
_bfs_query("bfs_pull", "G1", _PARENTS, ["id", "parent", "depth"], direction="pull")
_bfs_query("bfs_direction_optimizing", "G1", _PARENTS, ["id", "parent", "depth"], direction="auto")
_bfs_query("bfs_direction_plan", "G1", _PARENTS, ["id", "parent", "depth"], direction=["push", "pull", "push"])
_bfs_query("bfs_salted", "G1", _PARENTS, ["id", "parent", "depth"], how=SALTED)
_bfs_query("bfs_pull_partial_agg", "G1", _PARENTS, ["id", "parent", "depth"], direction="pull", how="partial_agg")
_bfs_query("bfs_pull_salted", "G1", _PARENTS, ["id", "parent", "depth"], direction="pull", how=SALTED)
_bfs_query("bfs_partial_agg", "G1", _PARENTS, ["id", "parent", "depth"], how="partial_agg")
_bfs_query(
    "bfs_complete", "G2",
    f"SELECT deg.id, coalesce(t.parent, -1) AS parent, coalesce(t.depth, -1) AS depth FROM deg LEFT JOIN ({_PARENTS}) t ON t.id = deg.id",
    ["id", "parent", "depth"], complete=True,
)


@query("bfs_levels", _with("G2", "SELECT depth, count(*) AS vertices FROM b GROUP BY depth", _BFS))
def bfs_levels(spark, sf_dir):
    g = graph(spark, sf_dir, "G2")
    return search.levels(search.bfs(g, source(g)))


_ONE = "SELECT e.dst AS id, min(e.src) AS parent FROM e WHERE e.src = (SELECT id FROM source) GROUP BY e.dst"


@query("bfs_push_epoch", _with("G1", _ONE))
def bfs_push_epoch(spark, sf_dir):
    g = graph(spark, sf_dir)
    start = g.vertices.filter(F.col("id") == source(g))
    return search.push_epoch(g, start, start, 1)


@query("bfs_pull_epoch", _with("G1", f"SELECT * FROM ({_ONE}) WHERE id >= 50 AND id < 5000"))
def bfs_pull_epoch(spark, sf_dir):
    g = graph(spark, sf_dir)
    start = g.vertices.filter(F.col("id") == source(g))
    return search.pull_epoch(g, start, start, 1, start=50, end=5000)


@query("khop_2", _with("G2", "SELECT id, depth FROM b WHERE depth <= 2", _BFS))
def khop_2(spark, sf_dir):
    g = graph(spark, sf_dir, "G2")
    return search.k_hop(g, source(g), 2)


# Shortest paths


def _sssp_query(name: str, g: str, **options) -> None:
    @query(name, _with(g, "SELECT id, dist FROM d", _SSSP.format(start="source")))
    def run(spark, sf_dir):
        own = graph(spark, sf_dir, g)
        return sssp(own, source(own), **options)


_sssp_query("sssp_dist", "G1")
_sssp_query("sssp_dist_deep", "G2")
_sssp_query("sssp_plain", "G1", how="plain")
_sssp_query("sssp_partial_agg", "G1", how="partial_agg")
_sssp_query("sssp_salted", "G1", how=SALTED)


@query("sssp_multi_source", _with("G2", "SELECT id, dist FROM d", _SSSP.format(start="(SELECT id FROM deg ORDER BY degree DESC, id LIMIT 3)")))
def sssp_multi_source(spark, sf_dir):
    g = graph(spark, sf_dir, "G2")
    start = g.degrees.orderBy(F.desc("degree"), "id").limit(3).select("id", F.lit(0.0).alias("dist"))
    return sssp(g, start)


@query("sssp_epoch", _with("G1", "SELECT e.dst AS id, min(e.w) AS dist FROM e WHERE e.src = (SELECT id FROM source) AND e.dst < 3000 GROUP BY e.dst"))
def sssp_epoch(spark, sf_dir):
    g = graph(spark, sf_dir)
    start = g.vertices.filter(F.col("id") == source(g)).select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh"))
    return relax_epoch(g, start, 1, start=0, end=3000).filter("fresh").select("id", "dist")


@query("sssp_segments", _with("G1", "SELECT id, dist FROM d", _SSSP.format(start="source")))
def sssp_segments(spark, sf_dir):
    g = graph(spark, sf_dir)
    return sssp(g, source(g), how=_plan(spark, g))


def _plan(spark, g: Graph):
    lanes = schedule.most_gain(schedule.costs(profile(spark)), COUNTS)
    return schedule.segment_plan(segments.equal_edge_ranges(g, 6), lanes, {k: k.split()[1] for _, k, _, _ in PROFILE})


# PageRank


def _rank_query(name: str, sql: str, **options) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        return pagerank(graph(spark, sf_dir), **options).select("id", F.round("score", 9).alias("score"))


_TEN = _with("G1", f", {_ranks_sql(10)} SELECT id, round(score, 9) AS score FROM r10").replace(" , r0", ", r0")
_rank_query("pagerank_10", _TEN, max_epochs=10, tol=-1.0, freeze=False)
_rank_query("pagerank_salted", _TEN, max_epochs=10, tol=-1.0, freeze=False, how=SALTED)
_rank_query("pagerank_partial_agg", _TEN, max_epochs=10, tol=-1.0, freeze=False, how="partial_agg")


@query("pagerank_epoch", _with("G1", f", {_ranks_sql(1, 5e-8)} SELECT id, round(score, 9) AS score FROM r1").replace(" , r0", ", r0"))
def pagerank_epoch(spark, sf_dir):
    g = graph(spark, sf_dir)
    start = g.degrees.withColumn("score", F.lit(1.0) / g.num_nodes)
    return rank_epoch(g, start).select("id", F.round("score", 9).alias("score"))


@query("pagerank_segments", _TEN)
def pagerank_segments(spark, sf_dir):
    g = graph(spark, sf_dir)
    return pagerank(g, max_epochs=10, tol=-1.0, freeze=False, how=_plan(spark, g)).select("id", F.round("score", 9).alias("score"))


@query(
    "pagerank_epoch_range",
    _with("G1", f", {_ranks_sql(1, 5e-8)} SELECT r1.id, round(CASE WHEN r1.id >= 100 AND r1.id < 300 THEN r1.score ELSE r0.score END, 9) AS score FROM r1 JOIN r0 USING (id)").replace(" , r0", ", r0"),
)
def pagerank_epoch_range(spark, sf_dir):
    g = graph(spark, sf_dir)
    start = g.degrees.withColumn("score", F.lit(1.0) / g.num_nodes)
    return rank_epoch(g, start, start=100, end=300).select("id", F.round("score", 9).alias("score"))


@query("pagerank_converged", _with("G1", "SELECT count(*) AS vertices, 1.0::DOUBLE AS total, 0::BIGINT AS unsettled FROM deg"))
def pagerank_converged(spark, sf_dir):
    """The fixpoint: scores sum to 1, and one more epoch moves none by over the tolerance."""
    g = graph(spark, sf_dir)
    ranks = pagerank(g)
    again = rank_epoch(g, g.degrees.join(ranks, "id"), freeze=False)
    return again.agg(F.count("*").alias("vertices"), F.round(F.sum("score"), 4).alias("total"), F.count_if("moved").alias("unsettled"))


# Verification


# Results damaged in known places, which SQL counts on its own.


_DAMAGED_BFS = f"""p AS ({_PARENTS}), d AS (SELECT id, depth, CASE WHEN id % 7 = 1 THEN NULL WHEN id % 7 = 2 THEN id WHEN id % 7 = 3 THEN id + 2 ELSE parent END AS parent FROM p)
SELECT count(*) FILTER (parent IS NULL) AS wrong_reach, count(*) FILTER (depth = 0 AND parent IS DISTINCT FROM id) AS wrong_source,
  count(*) FILTER (depth > 0 AND parent IS NOT NULL AND depth IS DISTINCT FROM (SELECT u.depth + 1 FROM p u WHERE u.id = d.parent)) AS wrong_depth,
  count(*) FILTER (depth > 0 AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = d.parent AND e.dst = d.id)) AS not_an_edge FROM d"""


@query("verify_bfs", _with("G1", _DAMAGED_BFS, _BFS + ", ").replace(",  p AS", ", p AS"))
def verify_bfs(spark, sf_dir):
    g = graph(spark, sf_dir)
    s = source(g)
    part = F.col("id") % 7
    parent = F.when(part == 1, -1).when(part == 2, F.col("id")).when(part == 3, F.col("id") + 2).otherwise(F.col("parent"))
    found = search.bfs(g, s)
    return verify.verify_bfs(g, s, found.select("id", parent.alias("parent")), search.bfs(g, s, direction="pull"))


@query("verify_sssp", _with("G1", "SELECT count(*) FILTER (id % 5 IN (1, 2)) AS wrong_dist FROM d", _SSSP.format(start="source")))
def verify_sssp(spark, sf_dir):
    g = graph(spark, sf_dir)
    part = F.col("id") % 5
    damaged = F.when(part == 1, F.col("dist") + 1).otherwise(F.col("dist"))
    return verify.verify_sssp(sssp(g, source(g), how=SALTED).filter(part != 2).select("id", damaged.alias("dist")), sssp(g, source(g)))


@query("verify_pagerank", _with("G1", "SELECT count(*) FILTER (id % 4 IN (1, 2)) AS wrong_score FROM deg"))
def verify_pagerank(spark, sf_dir):
    g = graph(spark, sf_dir)
    part = F.col("id") % 4
    damaged = F.when(part == 1, F.col("score") * 1.001).when(part == 3, F.col("score") * 1.00001).otherwise(F.col("score"))
    found = pagerank(g, max_epochs=5, how=SALTED).filter(part != 2).select("id", damaged.alias("score"))
    return verify.verify_pagerank(found, pagerank(g, max_epochs=5, how="plain"))


@query("verify_damaged_graph", _with("G1", """SELECT count(DISTINCT src) FILTER (src % 10 = 3)::BIGINT AS wrong_vertices,
  (count(*) FILTER (src % 10 = 3) + 2 * count(*) FILTER (src % 10 <> 3 AND dst % 10 = 5))::BIGINT AS wrong_edges FROM e"""))  # fmt: skip
def verify_damaged_graph(spark, sf_dir):
    g = graph(spark, sf_dir)
    w = F.when(F.col("dst") % 10 == 5, F.col("w") + 1).otherwise(F.col("w"))
    other = Graph(g.edges.filter("src % 10 <> 3").withColumn("w", w), g.vertices.filter("id % 10 <> 3"))
    return verify.verify_same_graph(g, other).select(F.col("wrong_vertices").cast("long").alias("wrong_vertices"), F.col("wrong_edges").cast("long").alias("wrong_edges"))


@query("verify_same_graph", "SELECT 0::BIGINT AS wrong_vertices, 0::BIGINT AS wrong_edges")
def verify_same_graph(spark, sf_dir):
    g = graph(spark, sf_dir, "G2")
    back = construct.relabel(g.ordered(), construct.degree_ranks(g.degrees).select(F.col("rank").alias("id"), F.col("id").alias("new")))
    return verify.verify_same_graph(g, back).select(F.col("wrong_vertices").cast("long").alias("wrong_vertices"), F.col("wrong_edges").cast("long").alias("wrong_edges"))


# Files: written to the shared folder and read again.


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which is a path that all tasks can open."""
    folder = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/files/{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


_RANKED = "rk AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id DESC) - 1 AS new FROM deg)"


@query("csr_round_trip", _with("G1", f", {_RANKED} SELECT s.new AS src, d.new AS dst, e.w::FLOAT::DOUBLE AS w FROM e JOIN rk s ON s.id = e.src JOIN rk d ON d.id = e.dst").replace(" , rk", ", rk"))
def csr_round_trip(spark, sf_dir):
    path = f"{_folder(spark)}/graph.wsg"
    write_csr(graph(spark, sf_dir).ordered(), path)
    return load_csr(spark, path).edges


@query("csr_round_trip_unweighted", _with("G1", f", {_RANKED} SELECT s.new AS src, d.new AS dst FROM e JOIN rk s ON s.id = e.src JOIN rk d ON d.id = e.dst").replace(" , rk", ", rk"))
def csr_round_trip_unweighted(spark, sf_dir):
    path = f"{_folder(spark)}/graph.sg"
    write_csr(graph(spark, sf_dir).ordered().unweighted(), path)
    return load_csr(spark, path).edges


@query("csr_vertices", _with("G1", "SELECT count(*) AS vertices, max(degree) AS max_degree FROM deg"))
def csr_vertices(spark, sf_dir):
    path = f"{_folder(spark)}/graph.wsg"
    write_csr(graph(spark, sf_dir).ordered(), path)
    loaded = load_csr(spark, path)
    return loaded.degrees.agg(F.count("*").alias("vertices"), F.max("degree").alias("max_degree"))


@query("profile_round_trip", f"WITH {_PROFILE_SQL} SELECT device, kernel, segment, millis FROM p")
def profile_round_trip(spark, sf_dir):
    folder, empty = _folder(spark), dict.fromkeys(("start_id", "end_id", "avg_degree", "min_degree", "max_degree", "num_edges", "gteps"), 0)
    for i, (device, kernel) in enumerate(sorted({(d, k) for d, k, _, _ in PROFILE})):
        rows = [empty | {"device_name": d, "kernel_name": k, "millisecs": m} for d, k, _, m in PROFILE if (d, k) == (device, kernel)]
        with open(f"{folder}/profile{i}.yaml", "w", encoding="utf-8") as f:
            f.write(to_yaml(rows))
    return read_profiles(spark, f"{folder}/*.yaml")


@query("schedule_round_trip", """SELECT * FROM (VALUES ('CPU A', 0, 2, 'sssp plain'), ('CPU A', 3, 3, 'sssp salted'), ('NVIDIA B', 4, 5, 'sssp broadcast 256 256'))
  AS t(device, seg_start, seg_end, kernel)""")  # fmt: skip
def schedule_round_trip(spark, sf_dir):
    path = f"{_folder(spark)}/plan.skd"
    write_schedule([("CPU A", [(0, 2, "sssp plain"), (3, 3, "sssp salted")]), ("NVIDIA B", [(4, 5, "sssp broadcast 256 256")])], path)
    rows = [(device, a, b, kernel) for device, ranges in read_schedule(path) for a, b, kernel in ranges]
    return spark.createDataFrame(rows, "device string, seg_start int, seg_end int, kernel string")


# Reductions


_GROUPS = "SELECT src, min(w) AS least, max(w) AS most, bit_or(dst) AS bits, bool_or(w > 90000) AS any_dear, sum(dst)::BIGINT AS total FROM e GROUP BY src"


def _group_values() -> dict[str, tuple[str, str]]:
    return {"least": ("min", "w"), "most": ("max", "w"), "bits": ("or", "dst"), "any_dear": ("any", "dear"), "total": ("sum", "dst")}


@query("reduce_groups", _with("G1", _GROUPS))
def reduce_groups_(spark, sf_dir):
    return reduce_groups(graph(spark, sf_dir).edges.withColumn("dear", F.col("w") > 90000), "src", _group_values())


@query("reduce_all", _with("G2", f"SELECT e.src, e.dst, e.w, least, most, bits, any_dear, total FROM e JOIN ({_GROUPS}) g ON g.src = e.src"))
def reduce_all_(spark, sf_dir):
    edges = graph(spark, sf_dir, "G2").edges.withColumn("dear", F.col("w") > 90000)
    return reduce_all(edges, "src", _group_values()).drop("dear")


@query("reduce_salted", _with("G1", _GROUPS))
def reduce_salted(spark, sf_dir):
    edges = graph(spark, sf_dir).edges.withColumn("dear", F.col("w") > 90000)
    return salted_reduce(edges, "src", _group_values(), 8, F.hash("dst"))


# Generators: no SQL has their hashes.


@query("rmat_counts")
def rmat_counts(spark, sf_dir):
    edges = generate.rmat_edges(spark, 12, 16)
    return edges.agg(F.count("*").alias("edges"), F.min("src").alias("least"), F.greatest(F.max("src"), F.max("dst")).alias("greatest"))


@query("uniform_counts")
def uniform_counts(spark, sf_dir):
    edges = generate.add_weights(generate.uniform_edges(spark, 12, 16))
    return edges.agg(F.count("*").alias("edges"), F.round(F.avg("src"), 0).alias("mean_src"), F.round(F.avg("w"), 2).alias("mean_w"))


@query("generated_graph")
def generated_graph(spark, sf_dir):
    g = generate.generate(spark, 10, 8, ordered=True)
    return construct.degrees(g.edges).groupBy("degree").agg(F.count("*").alias("vertices"))


@query("rmat_bounds", "SELECT 65536::BIGINT AS edges, true AS inside, true AS skewed")
def rmat_bounds(spark, sf_dir):
    """All draws are there and in range, and the unpermuted graph leans to the small ids."""
    edges = generate.rmat_edges(spark, 12, 16, permute=False)
    inside = F.min(F.least("src", "dst")).between(0, 4095) & F.max(F.greatest("src", "dst")).between(0, 4095)
    return edges.agg(F.count("*").alias("edges"), inside.alias("inside"), (F.avg("src") < 1200).alias("skewed"))


@query("uniform_bounds", "SELECT 65536::BIGINT AS edges, true AS inside, true AS even, true AS weights_inside, true AS weights_even")
def uniform_bounds(spark, sf_dir):
    edges = generate.add_weights(generate.uniform_edges(spark, 12, 16))
    inside = F.min(F.least("src", "dst")).between(0, 4095) & F.max(F.greatest("src", "dst")).between(0, 4095)
    weights = (F.min("w") >= 0) & (F.max("w") < 1)
    return edges.agg(F.count("*").alias("edges"), inside.alias("inside"), F.avg("src").between(2000, 2095).alias("even"), weights.alias("weights_inside"), F.avg("w").between(0.49, 0.51).alias("weights_even"))


@query("integer_weights", "SELECT 1.0::DOUBLE AS least, 255.0::DOUBLE AS greatest, 0::BIGINT AS broken")
def integer_weights(spark, sf_dir):
    edges = generate.add_weights(generate.uniform_edges(spark, 12, 16), kind="int")
    return edges.agg(F.min("w").alias("least"), F.max("w").alias("greatest"), F.count_if(F.col("w") != F.floor("w")).alias("broken"))


@query("permuted_ids", "SELECT unnest(range(3000)) AS id, 1::BIGINT AS sources")
def permuted_ids(spark, sf_dir):
    """A permutation of 3000 ids, which is no power of two: each is the image of one."""
    ids = permute_columns(spark.range(3000), ["id"], 3000, generate.SEED)
    return ids.groupBy("id").agg(F.count("*").alias("sources"))


@query("generated_symmetric", "SELECT 0::BIGINT AS loops, 0::BIGINT AS repeats, 0::BIGINT AS one_way, 0::BIGINT AS falling")
def generated_symmetric(spark, sf_dir):
    """No loop, no repeat, each entry with its reverse of equal weight, degrees falling with the id."""
    g = generate.generate(spark, 10, 8, ordered=True)
    e = g.edges.select("src", "dst", "w")
    found = e.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"), (F.count("*") - F.count_distinct(F.struct("src", "dst"))).alias("repeats"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    found = found.join(F.broadcast(e.exceptAll(back).agg(F.count("*").alias("one_way"))))
    before = g.degrees.select((F.col("id") + 1).alias("id"), F.col("degree").alias("before"))
    up = before.join(g.degrees, "id").agg(F.count_if(F.col("degree") > F.col("before")).alias("falling"))
    return found.join(F.broadcast(up))


@query("source_picks_eligible", _with("G1", "SELECT draw, id IS NOT NULL AS eligible, 1::BIGINT AS times FROM (SELECT unnest(range(8))::INT AS draw) LEFT JOIN (SELECT min(src) AS id FROM e) ON true"))
def source_picks_eligible(spark, sf_dir):
    """Eight draws are eight different vertices with an edge."""
    g = graph(spark, sf_dir)
    picks = spark.createDataFrame(list(enumerate(segments.SourcePicker(g).take(8))), "draw int, id long")
    times = picks.groupBy("id").agg(F.count("*").alias("times"))
    ok = segments.eligible_sources(g).withColumn("eligible", F.lit(True))
    return picks.join(times, "id").join(ok, "id", "left").select("draw", F.coalesce("eligible", F.lit(False)).alias("eligible"), "times")


@query("degree_of_source", _with("G1", "SELECT id, degree FROM deg WHERE id = (SELECT id FROM source)"))
def degree_of_source(spark, sf_dir):
    g = graph(spark, sf_dir)
    return spark.createDataFrame([(source(g), construct.degree_of(g.edges, source(g)))], "id long, degree long")


# Benchmarks and schedules


@query("segment_benchmark", _with("G1", f", {_segments_sql(4)} SELECT segment, min(id) AS start_id, max(id) + 1 AS end_id, sum(degree)::BIGINT AS num_edges, true AS timed FROM seg GROUP BY segment").replace(" , idx", ", idx"))
def segment_benchmark(spark, sf_dir):
    """The rows of a layer benchmark without their times, which differ from run to run."""
    rows = benchmarks.layer(graph(spark, sf_dir), "sssp plain", 4, runs=1)
    return spark.createDataFrame([(r["segment"], r["start_id"], r["end_id"], r["num_edges"], r["millisecs"] > 0) for r in rows], "segment long, start_id long, end_id long, num_edges long, timed boolean")


@query("tree_benchmark", _with("G1", "SELECT depth, (1 << depth)::BIGINT AS segments, (SELECT count(*) FROM e) AS num_edges FROM (SELECT unnest(range(3)) AS depth)"))
def tree_benchmark(spark, sf_dir):
    rows = benchmarks.tree(graph(spark, sf_dir), "pagerank partial_agg", 2, runs=1)
    rows = spark.createDataFrame([(r["depth"], r["num_edges"]) for r in rows], "depth long, num_edges long")
    return rows.groupBy("depth").agg(F.count("*").alias("segments"), F.sum("num_edges").alias("num_edges"))


@query("gteps", _with("G1", "SELECT count(*) AS num_edges, count(*) / (250.0 / 1000) / 1e9 / 2 AS gteps FROM e"))
def gteps(spark, sf_dir):
    n = graph(spark, sf_dir).edges.agg(F.count("*").alias("num_edges"))
    return n.select("num_edges", benchmarks.gteps(F.col("num_edges"), F.lit(250.0)).alias("gteps"))


@query("profile_best_kernel", f"{_BEST_SQL} SELECT device, segment, kernel, millis FROM best")
def profile_best_kernel(spark, sf_dir):
    return schedule.best_kernels(profile(spark))


@query("gains", f"{_BEST_SQL} SELECT a.segment, a.device AS device_from, b.device AS device_to, b.millis / a.millis AS gain FROM best a JOIN best b USING (segment)")
def gains(spark, sf_dir):
    return schedule.gains(profile(spark))


@query("best_single_device", f"{_BEST_SQL} SELECT device, sum(millis) AS millis FROM best GROUP BY device ORDER BY 2, 1 LIMIT 1")
def best_single_device(spark, sf_dir):
    return schedule.best_single_device(profile(spark))


@query("profiles_on_hardware", f"WITH {_PROFILE_SQL} SELECT device, kernel, segment, millis FROM p WHERE device = 'NVIDIA B'")
def profiles_on_hardware(spark, sf_dir):
    return schedule.on_hardware(profile(spark), {"CPU A": 0, "NVIDIA B": 2})


@query("contiguify", f"""{_BEST_SQL}, runs AS (SELECT *, segment - row_number() OVER (PARTITION BY device, kernel ORDER BY segment) AS run FROM best)
SELECT device, (CASE device WHEN 'CPU A' THEN 0 ELSE 1 END)::INT AS device_id, min(segment) AS seg_start, max(segment) AS seg_end, kernel, sum(millis) AS exec_time
FROM runs GROUP BY device, kernel, run""")  # fmt: skip
def contiguify(spark, sf_dir):
    best = schedule.best_kernels(profile(spark))
    ids = F.when(F.col("device") == "CPU A", 0).otherwise(1)
    return schedule.contiguify(best.select("device", ids.alias("device_id"), "segment", "kernel", "millis"))


@query("most_gain_schedule")
def most_gain_schedule(spark, sf_dir):
    return schedule.contiguify(_lanes(spark))


@query("schedule_matrix")
def schedule_matrix(spark, sf_dir):
    return schedule.matrix(_lanes(spark))


@query("schedule_worst_time")
def schedule_worst_time(spark, sf_dir):
    lanes = _lanes(spark).groupBy("device_id").agg(F.sum("millis").alias("millis"))
    return lanes.agg(F.max("millis").alias("worst_time"))


#: Every way to give six segments to one CPU and two GPUs, each by its best kernel.
_CHOICES = f"""{_BEST_SQL}, lanes AS (SELECT * FROM (VALUES (0, 'CPU A'), (1, 'NVIDIA B'), (2, 'NVIDIA B')) AS t(lane, device)),
c AS (SELECT segment, lane, millis FROM best JOIN lanes USING (device)),
ways AS (SELECT {', '.join(f'c{i}.lane AS l{i}, c{i}.millis AS m{i}' for i in range(6))}
  FROM {', '.join(f'(SELECT * FROM c WHERE segment = {i}) c{i}' for i in range(6))}),
times AS (SELECT greatest({', '.join('+'.join(f'CASE WHEN l{i} = {n} THEN m{i} ELSE 0 END' for i in range(6)) for n in range(3))}) AS longest FROM ways)"""


@query("schedule_exhaustive_time", f"{_CHOICES} SELECT min(longest) AS worst_time FROM times")
def schedule_exhaustive_time(spark, sf_dir):
    lanes = schedule.exhaustive(PROFILE, COUNTS)
    return spark.createDataFrame([(schedule.worst_time(lanes),)], "worst_time double")


@query("schedule_covers", "SELECT unnest(range(6))::INT AS segment, 1::BIGINT AS times")
def schedule_covers(spark, sf_dir):
    return _lanes(spark).groupBy("segment").agg(F.count("*").alias("times"))


@query("schedule_bounds", f"{_CHOICES}, one AS (SELECT min(m) AS single FROM (SELECT sum(millis) AS m FROM best GROUP BY device)) SELECT single, true AS not_under_optimum, true AS not_over_single FROM one")
def schedule_bounds(spark, sf_dir):
    """The most-gain schedule is between the exhaustive optimum and the best device alone."""
    single, worst = schedule.best_single_device(profile(spark)).first().millis, schedule.worst_time(schedule.most_gain(schedule.costs(profile(spark)), COUNTS))
    return spark.createDataFrame([(single, worst >= schedule.worst_time(schedule.exhaustive(PROFILE, COUNTS)), worst <= single)], "single double, not_under_optimum boolean, not_over_single boolean")


@query("parse_kernel", f"""WITH {_PROFILE_SQL} SELECT DISTINCT kernel, CASE WHEN regexp_matches(kernel, '\\d+ \\d+$') THEN regexp_extract(kernel, '^(.*\\S)\\s+\\d+\\s+\\d+$', 1) ELSE kernel END AS name,
  try_cast(regexp_extract(kernel, '(\\d+)\\s+\\d+$', 1) AS INT) AS blocks, try_cast(regexp_extract(kernel, '\\d+\\s+(\\d+)$', 1) AS INT) AS threads FROM p""")  # fmt: skip
def parse_kernel_(spark, sf_dir):
    rows = profile(spark).select("kernel").distinct()
    return rows.select("kernel", parse_kernel(F.col("kernel")).alias("k")).select("kernel", "k.name", "k.blocks", "k.threads")
