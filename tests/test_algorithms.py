import math
import random

import pytest
from graphs import DETOUR, MULTI, PATH5, SPLIT, STAR6, TIE, ZERO, make, rows
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import bfs as search
from graphloom.operators import verify
from graphloom.operators.pagerank import pagerank
from graphloom.operators.sssp import dijkstra, relax_epoch, sssp
from graphloom.plans.strategies import STRATEGIES, SegmentPlan, Strategy

SALTED = Strategy("salted", hub_degree=3, salts=4)


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60) if rng.random() < 0.8 else 0, float(rng.randrange(1, 20))) for _ in range(110)]
    return make(spark, edges, extra=[100])


def reference_depths(edges, source):
    out, level, near = {source: 0}, [source], {}
    for s, d, *_ in edges:
        near.setdefault(s, []).append(d)
    while level:
        nxt = sorted({d for s in level for d in near.get(s, ()) if d not in out})
        out.update({d: out[level[0]] + 1 for d in nxt})
        level = nxt
    return out


def test_path_and_star(spark):
    assert rows(make(spark, PATH5).bfs(0)) == [(0, 0, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4)]
    assert rows(make(spark, STAR6).bfs(3)) == [(0, 3, 1), (1, 0, 2), (2, 0, 2), (3, 3, 0), (4, 0, 2), (5, 0, 2)]


@pytest.mark.parametrize("direction", ["push", "pull", "auto", ["push", "pull"]])
def test_parent_is_the_least(spark, direction):
    assert rows(make(spark, TIE).bfs(0, direction=direction)) == [(0, 0, 0), (1, 0, 1), (2, 0, 1), (3, 1, 2)]


def test_unreached_and_missing_source(spark):
    g = make(spark, SPLIT, extra=[4])
    assert rows(g.bfs(0, complete=True)) == [(0, 0, 0), (1, 0, 1), (2, -1, -1), (3, -1, -1), (4, -1, -1)]
    assert g.bfs(99).count() == 0
    assert rows(g.sssp(0, complete=True)) == [(0, 0.0), (1, 1.0), (2, math.inf), (3, math.inf), (4, math.inf)]
    with pytest.raises(ValueError):
        g.bfs(0, direction="sideways")
    with pytest.raises(ValueError):
        g.bfs(0, direction=[])


@pytest.mark.parametrize("how", [*STRATEGIES, SALTED, Strategy("broadcast", broadcast_rows=0)], ids=str)
def test_strategies_agree(spark, random_graph, how):
    g = random_graph
    edges = rows(g.edges)
    depths = reference_depths(edges, 0)
    got = g.bfs(0, how=how)
    assert {r.id: r.depth for r in got.collect()} == depths
    for r in got.collect():
        up = [s for s, d, _ in edges if d == r.id and depths.get(s) == r.depth - 1]
        assert r.parent == (min(up) if up else r.id)
    assert {r.id: r.dist for r in g.sssp(0, how=how).collect()} == dijkstra(edges, 0)


@pytest.mark.parametrize("direction", ["pull", "auto"])
def test_directions_agree(spark, random_graph, direction):
    assert rows(random_graph.bfs(0, direction=direction)) == rows(random_graph.bfs(0))


def test_direction_rule():
    rule = search.DirectionRule(num_nodes=1000, num_edges=1500)
    assert rule.next(1, 50) == "push" and rule.to_check == 1450
    assert rule.next(100, 500) == "pull"  # 500 is over 1450 // 15
    assert rule.next(200, 0) == "pull"  # the frontier grew
    assert rule.next(60, 0) == "pull"  # it shrank, but is over 1000 // 18
    assert rule.next(10, 900) == "push" and rule.to_check == 1449


def test_one_epoch_in_a_range(spark):
    g = make(spark, STAR6)
    start = g.vertices.filter("id = 0")
    assert rows(search.pull_epoch(g, start, start, 1, start=2, end=4)) == [(2, 0), (3, 0)]
    state = start.select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh"))
    assert rows(relax_epoch(g, state, 1, start=1, end=3).filter("fresh").select("id", "dist")) == [(1, 1.0), (2, 1.0)]


def test_paths_by_weight(spark):
    assert rows(make(spark, DETOUR).sssp(0)) == [(0, 0.0), (1, 2.0), (2, 1.0)]
    assert rows(make(spark, ZERO).sssp(0)) == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert rows(make(spark, MULTI).sssp(0)) == [(0, 0.0), (1, 2.0), (2, 3.0)]


def test_multi_source_and_bad_weights(spark):
    g = make(spark, PATH5)
    start = spark.createDataFrame([(0, 0.0), (4, 0.5), (2, math.inf), (0, 3.0)], "id long, dist double")
    assert rows(sssp(g, start)) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 1.5), (4, 0.5)]
    with pytest.raises(ValueError):
        g.unweighted().sssp(0)
    negative = Graph(spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, w double"), spark.range(2))
    with pytest.raises(ValueError):
        negative.sssp(0)


def test_segment_plan(spark, random_graph):
    plan = SegmentPlan.of([(0, 10, "plain"), (10, 30, SALTED), (30, None, "broadcast")])
    g = random_graph
    assert rows(g.sssp(0, how=plan)) == rows(g.sssp(0))
    assert rows(g.bfs(0, how=plan)) == rows(g.bfs(0))
    with pytest.raises(ValueError):
        SegmentPlan.of([(0, 10, "plain"), (5, 20, "plain")])


def reference_ranks(edges, ids, epochs, damping=0.85):
    degree = {i: 0 for i in ids}
    for s, *_ in edges:
        degree[s] += 1
    score = {i: 1 / len(ids) for i in ids}
    for _ in range(epochs):
        got = dict.fromkeys(ids, 0.0)
        for s, d, *_ in edges:
            got[d] += score[s] / degree[s]
        score = {i: (1 - damping) / len(ids) + damping * got[i] for i in ids}
    return score


@pytest.mark.parametrize("how", ["plain", "partial_agg", SALTED, "broadcast"], ids=str)
def test_ranks(spark, random_graph, how):
    g = random_graph
    want = reference_ranks(rows(g.edges), [r.id for r in g.vertices.collect()], 6)
    got = {r.id: r.score for r in pagerank(g, max_epochs=6, tol=-1.0, freeze=False, how=how).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want)


def test_ranks_converge_to_one(spark):
    trace = []
    g = make(spark, TIE)
    total = pagerank(g, tol=1e-10, trace=trace).agg(F.sum("score")).first()[0]
    assert math.isclose(total, 1.0, rel_tol=1e-7)
    assert trace[-1].values["updated"] == 0 and len(trace) < 201


def test_frozen_ranks_and_init(spark):
    g = make(spark, STAR6, extra=[7])
    start = g.vertices.select("id", F.lit(1 / 7).alias("score"))
    assert rows(pagerank(g, init=start, max_epochs=3)) == rows(pagerank(g, max_epochs=3))
    alone = {r.id: r.score for r in pagerank(g, tol=1e-6).collect()}[7]
    assert math.isclose(alone, 0.15 / 7, rel_tol=1e-9)


def test_empty_graph(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long, w double"))
    assert g.bfs(0).count() == 0 and g.sssp(0).count() == 0 and g.pagerank().count() == 0


def test_edge_properties(spark, random_graph):
    g = random_graph
    depth, dist = g.bfs(0).select("id", "depth"), g.sssp(0)
    both = g.edges.join(depth.toDF("src", "a"), "src").join(depth.toDF("dst", "b"), "dst")
    assert both.filter(F.abs(F.col("a") - F.col("b")) > 1).count() == 0
    paths = g.edges.join(dist.toDF("src", "a"), "src").join(dist.toDF("dst", "b"), "dst")
    assert paths.filter("b > a + w").count() == 0


def test_verifiers_find_errors(spark):
    g = make(spark, PATH5)
    true = g.bfs(0)
    assert verify.verify_bfs(g, 0, true, true).first() == (0, 0, 0, 0)
    wrong = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (4, -1)], "id long, parent long")
    got = verify.verify_bfs(g, 0, wrong, true).first().asDict()
    assert got == {"wrong_reach": 1, "wrong_source": 1, "wrong_depth": 1, "not_an_edge": 1}
    dist = g.sssp(0)
    off = dist.withColumn("dist", F.when(F.col("id") == 2, 9.0).otherwise(F.col("dist")))
    assert verify.verify_sssp(dist, dist).first()[0] == 0 and verify.verify_sssp(off, dist).first()[0] == 1
    assert rows(verify.first_errors(verify.differences(off, dist))) == [(2, 9.0, 2.0)]
    ranks = g.pagerank(max_epochs=4)
    assert verify.verify_pagerank(ranks, ranks).first()[0] == 0
    assert verify.verify_pagerank(ranks.withColumn("score", F.col("score") * 1.1), ranks).first()[0] == 5
    assert verify.verify_same_graph(g, make(spark, PATH5)).first() == (0, 0)
    assert verify.verify_same_graph(g, make(spark, STAR6)).first()[1] > 0
