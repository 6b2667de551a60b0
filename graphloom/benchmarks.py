"""Benchmark harness: segments, layers, trees and full runs of the three algorithms."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.random import uniform
from graphloom.model import Graph
from graphloom.operators.bfs import bfs
from graphloom.operators.pagerank import pagerank, rank_epoch
from graphloom.operators.segments import SourcePicker, segment_stats
from graphloom.operators.sssp import relax_epoch, sssp
from graphloom.plans.strategies import STRATEGIES

WARM_UP, SEGMENT_RUNS, FULL_RUNS, SEED = 1, 5, 64, 1024

#: Kernel names to (algorithm, options).
KERNELS = {
    **{f"sssp {s}": ("sssp", {"how": s}) for s in STRATEGIES},
    **{f"pagerank {s}": ("pagerank", {"how": s}) for s in STRATEGIES},
    **{f"bfs push {s}": ("bfs", {"how": s, "direction": "push"}) for s in STRATEGIES},
    "bfs pull": ("bfs", {"direction": "pull"}),
    "bfs auto": ("bfs", {"direction": "auto"}),
}


def device_name(graph: Graph) -> str:
    return f"Spark {graph.spark.sparkContext.master}"


def gteps(edges, millis):
    """Billions of undirected edges a second; numbers or columns."""
    return edges / (millis / 1000) / 1e9 / 2


def initial_values(graph: Graph, name: str, seed: int = SEED) -> DataFrame:
    """(id, ``name``) with a seeded uniform draw for each vertex."""
    return graph.vertices.select("id", uniform(seed, F.col("id")).alias(name))


def _algorithm(kernel: str) -> tuple[str, dict]:
    if kernel not in KERNELS:
        raise ValueError(f"no kernel {kernel!r}; there are {sorted(KERNELS)}")
    return KERNELS[kernel]


def _millis(action) -> float:
    began = time.perf_counter()
    action()
    return (time.perf_counter() - began) * 1000


def segments(graph: Graph, kernel: str, k: int, runs: int = SEGMENT_RUNS, depth: int = 0) -> list[dict]:
    """A row for each of ``k`` equal-edge segments: one epoch into it, averaged over ``runs``."""
    algorithm, options = _algorithm(kernel)
    if algorithm == "bfs":
        raise ValueError("segments are timed for sssp and pagerank; bfs in full runs")
    if algorithm == "sssp":
        state = initial_values(graph, "dist").withColumn("fresh", F.lit(True)).persist()
        epoch = lambda a, b: relax_epoch(graph, state, None, options["how"], a, b)
    else:
        state = initial_values(graph, "score").join(graph.degrees, "id").persist()
        epoch = lambda a, b: rank_epoch(graph, state, how=options["how"], start=a, end=b)
    state.count()
    out = []
    for r in segment_stats(graph, k).orderBy("segment").collect():
        run = lambda r=r: epoch(r.start_id, r.end_id).write.format("noop").mode("overwrite").save()
        millis = sum(_millis(run) for _ in range(runs)) / runs
        out.append(
            {
                "depth": depth, "segment": r.segment, "start_id": r.start_id, "end_id": r.end_id, "avg_degree": r.avg_degree,
                "min_degree": float(r.min_degree), "max_degree": float(r.max_degree), "num_edges": r.num_edges, "millisecs": millis,
                "gteps": gteps(r.num_edges, millis), "device_name": device_name(graph), "kernel_name": kernel,
            }
        )
    state.unpersist()
    return out


def layer(graph: Graph, kernel: str, k: int, runs: int = SEGMENT_RUNS) -> list[dict]:
    return segments(graph, kernel, k, runs)


def tree(graph: Graph, kernel: str, depth: int, runs: int = SEGMENT_RUNS) -> list[dict]:
    """Layers of 1, 2, ... 2^``depth`` segments, after a warm-up layer that does not count."""
    segments(graph, kernel, 1, WARM_UP)
    return [row for d in range(depth + 1) for row in segments(graph, kernel, 1 << d, runs, d)]


def full(graph: Graph, kernel: str, runs: int = FULL_RUNS, source: int | None = None) -> dict:
    """Whole runs from seeded sources (PageRank from 1/N each time), averaged."""
    algorithm, options = _algorithm(kernel)
    sources = SourcePicker(graph, source).take(runs)
    total = graph.num_edges
    graph.degrees.count()
    times = []
    for s in sources:
        run = {"bfs": lambda s=s: bfs(graph, s, **options), "sssp": lambda s=s: sssp(graph, s, **options), "pagerank": lambda: pagerank(graph, **options)}[algorithm]
        times.append(_millis(run))
    millis = sum(times) / len(times)
    return {"kernel_name": kernel, "device_name": device_name(graph), "runs": runs, "num_edges": total, "millisecs": millis, "gteps": gteps(total, millis)}


def graph_sizes(spark, scales, degree: int = 16) -> list[dict]:
    """Seconds to generate, build and relabel a graph of each scale."""
    from graphloom.operators.construct import end_points, squish, symmetrize
    from graphloom.sources.generate import add_weights, rmat_edges

    out = []
    for scale in scales:
        raw = add_weights(rmat_edges(spark, scale, degree)).persist()
        row = {"scale": scale, "generate": _millis(raw.count) / 1000}
        graph = Graph(squish(symmetrize(raw)).persist(), end_points(raw).persist())
        row["build"] = _millis(lambda g=graph: (g.edges.count(), g.vertices.count())) / 1000
        row["relabel"] = _millis(lambda g=graph: g.ordered().edges.write.format("noop").mode("overwrite").save()) / 1000
        graph.release()
        for df in (graph.edges, graph.vertices, raw):
            df.unpersist()
        out.append(row)
    return out
