import struct

import pytest
from graphs import MULTI, PATH5, STAR6, make, rows
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import verify
from graphloom.sources import csr, generate, profiles


@pytest.mark.parametrize("ending", ["wsg", "sg"])
def test_csr_round_trip(spark, tmp_path, ending, monkeypatch):
    monkeypatch.setattr(csr, "SPLIT", 7)
    g = generate.generate(spark, 6, 4, weights="int", ordered=True)
    path = str(tmp_path / f"g.{ending}")
    csr.write_csr(g, path)
    back = csr.load_csr(spark, path)
    want = g if ending == "wsg" else g.unweighted()
    assert verify.verify_same_graph(want, back).first() == (0, 0)


def test_csr_layout_isolated_vertices_and_trailing_bytes(spark, tmp_path):
    g = make(spark, MULTI, extra=[3, 4])
    path = tmp_path / "g.wsg"
    csr.write_csr(g, str(path))
    data = path.read_bytes()
    assert struct.unpack_from("<iq", data) == (5, 4)
    assert struct.unpack_from("<6q", data, 12) == (0, 1, 3, 4, 4, 4)
    assert struct.unpack_from("<if", data, 60) == (1, 2.0)
    assert len(data) == 12 + 48 + 4 * 8
    path.write_bytes(data + b"junk" * 5)
    back = csr.load_csr(spark, str(path))
    assert back.num_nodes == 5 and rows(back.edges) == rows(g.edges)


def test_csr_refuses_bad_files(spark, tmp_path):
    short = tmp_path / "a.sg"
    short.write_bytes(b"\x01")
    with pytest.raises(ValueError):
        csr.header(str(short))
    short.write_bytes(csr.HEAD.pack(3, 100))
    with pytest.raises(ValueError):
        csr.header(str(short))
    with pytest.raises(ValueError):
        csr.is_weighted("a.bin")
    gap = Graph(spark.createDataFrame([(0, 5), (5, 0)], "src long, dst long"), spark.createDataFrame([(0,), (5,)], "id long"))
    with pytest.raises(ValueError):
        csr.write_csr(gap, str(tmp_path / "b.sg"))
    with pytest.raises(ValueError):
        csr.write_csr(make(spark, PATH5).unweighted(), str(tmp_path / "c.wsg"))


def test_csr_empty(spark, tmp_path):
    g = Graph(spark.createDataFrame([], "src long, dst long"), spark.range(3))
    csr.write_csr(g, str(tmp_path / "e.sg"))
    back = csr.load_csr(spark, str(tmp_path / "e.sg"))
    assert back.num_nodes == 3 and back.edges.count() == 0


def test_generators_do_not_depend_on_partitions(spark):
    one = generate.rmat_edges(spark, 7, 4)
    assert one.count() == 4 << 7
    assert rows(one) == rows(generate.rmat_edges(spark, 7, 4).repartition(3))
    assert rows(one) != rows(generate.rmat_edges(spark, 7, 4, seed=1))
    assert one.agg(F.min(F.least("src", "dst"))).first()[0] >= 0
    assert one.agg(F.max(F.greatest("src", "dst"))).first()[0] < 1 << 7


def test_rmat_quadrants(spark):
    edges = generate.rmat_edges(spark, 1, 20000, permute=False)
    n = {(r.src, r.dst): r["count"] / 40000 for r in edges.groupBy("src", "dst").count().collect()}
    for cell, share in {(0, 0): 0.57, (0, 1): 0.19, (1, 0): 0.19, (1, 1): 0.05}.items():
        assert abs(n[cell] - share) < 0.01


def test_uniform_and_weights(spark):
    edges = generate.add_weights(generate.uniform_edges(spark, 8, 64))
    mean = edges.agg(F.avg("src"), F.avg("w"), F.min("w"), F.max("w")).first()
    assert abs(mean[0] - 127.5) < 4 and abs(mean[1] - 0.5) < 0.02 and mean[2] >= 0 and mean[3] < 1
    whole = generate.add_weights(edges.drop("w"), kind="int").agg(F.min("w"), F.max("w")).first()
    assert whole[0] >= 1 and whole[1] <= 255
    with pytest.raises(ValueError):
        generate.add_weights(edges, kind="odd")


def test_generated_graph_is_clean(spark):
    g = generate.generate(spark, 6, 8, kind="uniform")
    assert g.edges.filter("src = dst").count() == 0
    assert g.edges.count() == g.edges.select("src", "dst").distinct().count()
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    assert back.exceptAll(g.edges).count() == 0
    for bad in ({"scale": -1}, {"scale": 3, "degree": 0}, {"scale": 3, "kind": "tree"}):
        with pytest.raises(ValueError):
            generate.generate(spark, **bad)


def test_command_line(spark, tmp_path):
    assert generate.main(["-s", "5", "-k", "4", "-o", str(tmp_path)]) == 0
    assert spark.read.parquet(str(tmp_path / "graph_scale5_degree4.parquet")).count() > 0
    assert generate.main(["-s", "4", "--format", "csr", "--unweighted", "-u", "-o", str(tmp_path)]) == 0
    assert csr.load_csr(spark, str(tmp_path / "graph_scale4_degree16.sg")).num_nodes > 0


def _row(segment, millis, depth=0):
    return {
        "depth": depth, "segment": segment, "start_id": segment * 2, "end_id": segment * 2 + 2, "avg_degree": 1.5, "min_degree": 1.0,
        "max_degree": 2.0, "num_edges": 3, "millisecs": millis, "gteps": 1e-9, "device_name": "CPU A", "kernel_name": "sssp plain",
    }


def test_profile_round_trip(spark, tmp_path):
    path = tmp_path / "epoch2_bfs_cpu_push_by_node.yaml"
    path.write_text(profiles.to_yaml([_row(0, 1.25), _row(1, 2.5e-05)]))
    assert rows(profiles.read_profiles(spark, str(path))) == [("CPU A", "sssp plain", 0, 1.25), ("CPU A", "sssp plain", 1, 2.5e-05)]
    (tmp_path / "epoch0_bfs_gpu_warp.yaml").write_text(profiles.to_yaml([_row(0, 4.0)]))
    (tmp_path / "epoch0_bfs_cpu_pull.yaml").write_text(profiles.to_yaml([_row(0, 5.0)]))
    got = rows(profiles.read_epoch_profiles(spark, str(tmp_path / "*.yaml")).select("epoch", "direction", "millis"))
    assert got == [(0, "pull", 4.0), (0, "pull", 5.0), (2, "push", 2.5e-05), (2, "push", 1.25)]


def test_yaml_shapes():
    assert profiles.to_yaml([_row(0, 1.0)], "segment").count("- start:") == 1
    tree = profiles.to_yaml([_row(0, 1.0), _row(0, 0.5, 1), _row(1, 0.5, 1)], "tree")
    assert tree.count("- depth:") == 2 and tree.count("- start:") == 3
    with pytest.raises(ValueError):
        profiles.to_yaml([_row(0, 1.0)], "bush")
    with pytest.raises(ValueError):
        profiles.to_yaml([])


def test_schedule_text(tmp_path):
    path = str(tmp_path / "a.skd")
    blocks = [("Processor 1", [(0, 1, "kernel one"), (3, 3, "kernel two 64 1024")]), ("Processor 2", [(2, 2, "kernel three")])]
    profiles.write_schedule(blocks, path)
    assert profiles.read_schedule(path) == blocks
    (tmp_path / "b.skd").write_text("0 1\nkernel\n")
    with pytest.raises(ValueError):
        profiles.read_schedule(str(tmp_path / "b.skd"))


def test_parse_kernel(spark):
    df = spark.createDataFrame([("warp 64 1024",), ("plain",), (" two words 1 2 ",)], "k string")
    got = [tuple(r.p) for r in df.select(profiles.parse_kernel(F.col("k")).alias("p")).collect()]
    assert got == [("warp", 64, 1024), ("plain", None, None), ("two words", 1, 2)]


def test_star_names(spark):
    assert generate.file_name(3, 4, True, "/x/") == "/x/graph_scale3_degree4.wsg"
    assert make(spark, STAR6).num_edges == 10
