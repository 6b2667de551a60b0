import pytest
from graphs import CYCLE8, MULTI, PATH5, SPLIT, STAR6, make, rows
from pyspark.sql import functions as F

from graphloom.functions.random import permute_columns
from graphloom.functions.reductions import reduce_all, reduce_groups, reduce_window, salted_reduce
from graphloom.model import Graph
from graphloom.operators import construct, segments


def test_squish_keeps_least_weight_and_drops_loops(spark):
    g = make(spark, MULTI)
    assert rows(g.edges) == [(0, 1, 2.0), (1, 0, 2.0), (1, 2, 1.0), (2, 1, 1.0)]


def test_symmetrize_missing_adds_only_what_is_absent(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 2), (1, 2)], "src long, dst long")
    assert rows(construct.symmetrize_missing(edges)) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_degrees_both_ways_and_isolated(spark):
    g = make(spark, SPLIT, extra=[4])
    assert rows(g.degrees) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    directed = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long")
    assert rows(construct.degrees(directed)) == [(0, 2), (1, 1)]
    assert rows(construct.degrees(directed, transpose=True)) == [(1, 1), (2, 2)]


def test_max_id_and_dense_vertices(spark):
    edges = spark.createDataFrame([(0, 5)], "src long, dst long")
    assert construct.max_id(edges).first()[0] == 5
    assert construct.dense_vertices(edges).count() == 6
    none = spark.createDataFrame([], "src long, dst long")
    assert construct.max_id(none).first()[0] is None
    assert construct.dense_vertices(none).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_prefix_sum_any_block(spark, block):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("v"))
    got = rows(construct.prefix_sum(df, "id", "v", "s", block).select("id", "s"))
    want, total = [], 0
    for i in range(50):
        want.append((i, total))
        total += i % 7
    assert got == want


def test_adjacency_and_csr(spark):
    g = make(spark, STAR6, extra=[9])
    got = {r.id: (r.offset, r.degree, [n.v for n in r.nbrs]) for r in construct.adjacency(g).collect()}
    assert got[0] == (0, 5, [1, 2, 3, 4, 5])
    assert got[3] == (7, 1, [0])
    assert got[9] == (10, 0, [])


@pytest.mark.parametrize("block", [1, 2, 1 << 20])
def test_ranks_break_ties_by_larger_id(spark, block):
    degrees = spark.createDataFrame([(0, 2), (1, 2), (2, 1), (3, 1)], "id long, degree long")
    assert rows(construct.degree_ranks(degrees, block).select("rank", "id")) == [(0, 1), (1, 0), (2, 3), (3, 2)]


def test_relabel_keeps_shape_and_refuses_directed(spark):
    g = make(spark, STAR6).ordered()
    assert construct.degree_of(g.edges, 0) == 5
    with pytest.raises(ValueError):
        Graph(g.edges, g.vertices, symmetric=False).ordered()


def test_neighbors_loops_subgraph(spark):
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "src long, dst long")
    assert rows(construct.neighbors(edges, 0)) == [(0,), (1,)]
    assert construct.has_self_loop(edges, 0) and not construct.has_self_loop(edges, 1)
    assert rows(construct.self_loops(edges)) == [(0,)]
    g = make(spark, PATH5)
    assert rows(construct.subgraph(g, 1, 4)) == [(1, 0, 2), (2, 2, 2), (3, 4, 2)]
    assert construct.subgraph_edges(g, 1, 2).count() == 2


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100])
def test_permutation_is_a_bijection(spark, n):
    got = sorted(r.id for r in permute_columns(spark.range(n), ["id"], n, 3).collect())
    assert got == list(range(n))


def test_segments_cover_every_vertex_once(spark):
    g = make(spark, CYCLE8)
    assert rows(segments.equal_edge_ranges(g, 4)) == [(0, 0, 2), (1, 2, 4), (2, 4, 6), (3, 6, 8)]
    assert sum(r.vertices for r in segments.segment_stats(g, 3).collect()) == 8
    hub = make(spark, STAR6)
    ranges = rows(segments.equal_edge_ranges(hub, 4))
    assert ranges[0][1] == 0 and ranges[-1][2] == 6
    assert all(a[2] == b[1] for a, b in zip(ranges, ranges[1:]))
    aligned = rows(segments.equal_edge_ranges(g, 3, chunk=4))
    assert [r[1] % 4 for r in aligned] == [0, 0, 0] and aligned[-1][2] == 8
    with pytest.raises(ValueError):
        segments.segment_of(g, 0)


def test_source_picker(spark):
    only = Graph(spark.createDataFrame([(0, 0)], "src long, dst long"), spark.range(1))
    with pytest.raises(ValueError):
        segments.SourcePicker(only).next()
    g = make(spark, SPLIT, extra=[4])
    picker = segments.SourcePicker(g)
    first = picker.take(6)
    assert set(first) == {0, 1, 2, 3}
    picker.reset()
    assert [picker.next() for _ in range(6)] == first
    assert segments.SourcePicker(g, constant=7).take(2) == [7, 7]


def test_reductions(spark):
    df = spark.createDataFrame([(0, 1, 3), (0, 2, 4), (1, 5, 8)], "g int, v int, b int")
    spec = {"lo": ("min", "v"), "hi": ("max", "v"), "all": ("sum", "v"), "bits": ("or", "b")}
    assert rows(reduce_groups(df, "g", spec)) == [(0, 1, 2, 3, 7), (1, 5, 5, 5, 8)]
    assert rows(salted_reduce(df, "g", spec, 3, F.hash("v"))) == [(0, 1, 2, 3, 7), (1, 5, 5, 5, 8)]
    assert rows(reduce_all(df, "g", {"lo": ("min", "v")}).select("v", "lo")) == [(1, 1), (2, 1), (5, 5)]
    assert rows(df.select("v", reduce_window("max", "v", "g").alias("hi"))) == [(1, 2), (2, 2), (5, 5)]
    with pytest.raises(ValueError):
        reduce_groups(df, "g", {"x": ("median", "v")})
