import random

import pytest
from graphs import CYCLE8, make, rows

from graphloom import benchmarks
from graphloom.operators.segments import equal_edge_ranges
from graphloom.plans import schedule
from graphloom.plans.schedule import Lane, Task
from graphloom.queries import COUNTS, PROFILE


def table(profile_rows):
    out = {}
    for d, k, s, m in sorted(profile_rows, key=lambda r: (r[3], r[1])):
        out.setdefault(d, {}).setdefault(s, Task(s, k, m))
    return out


def covered(lanes):
    return sorted(t.segment for lane in lanes for t in lane.tasks)


def test_costs_match_the_query(spark):
    profile = spark.createDataFrame(PROFILE, schedule.PROFILE_SCHEMA)
    assert schedule.costs(profile) == table(PROFILE)


@pytest.mark.parametrize("seed", range(6))
def test_most_gain_is_whole_and_near_the_best(seed):
    rng = random.Random(seed)
    rows_ = [(d, k, s, float(rng.randrange(1, 20))) for d in ("A", "B") for k in ("x", "y") for s in range(5)]
    counts = {"A": 1 + seed % 2, "B": 1}
    lanes = schedule.most_gain(table(rows_), counts)
    best = schedule.exhaustive(rows_, counts)
    assert covered(lanes) == covered(best) == list(range(5))
    assert schedule.metric(best) <= schedule.metric(lanes)
    single = min(sum(t.millis for t in row.values()) for row in table(rows_).values())
    assert schedule.worst_time(lanes) <= single


def test_exhaustive_metric_order():
    a, b = Lane("A", (Task(0, "k", 3.0),)), Lane("B", (Task(1, "k", 1.0),))
    assert schedule.metric([a, b]) == (3.0, 4.0, 4.0)
    assert schedule.speed_up([a, b], 6.0) == 2.0


def test_even_out_keeps_ranges_contiguous():
    tasks = tuple(Task(i, "k", float(m)) for i, m in enumerate((5, 1, 1, 1)))
    left, right = schedule.even_out([Lane("A", tasks), Lane("A")])
    assert covered([left, right]) == [0, 1, 2, 3]
    assert [t.segment for t in left.tasks] == [0] and [t.segment for t in right.tasks] == [1, 2, 3]
    left, right = schedule.even_out([Lane("A"), Lane("A", tasks)])
    assert [t.segment for t in left.tasks] == [0]


def test_missing_devices():
    with pytest.raises(ValueError):
        schedule.most_gain(table(PROFILE), {"other": 1})
    with pytest.raises(ValueError):
        schedule.most_gain(table(PROFILE), {"CPU A": 0})


def test_push_or_pull():
    pull = table(PROFILE)
    way, lanes = schedule.push_or_pull([("CPU A", "push", 0.5)], pull, COUNTS)
    assert way == "push" and covered(lanes) == list(range(6)) and len(lanes) == 3
    assert abs(schedule.worst_time(lanes) - 0.5) < 1e-12
    assert schedule.push_or_pull([("CPU A", "push", 500.0)], pull, COUNTS)[0] == "pull"
    assert schedule.push_or_pull([], pull, COUNTS)[0] == "pull"


def test_push_pull_schedule(spark):
    rows_ = [(e, "pull", d, k, s, m) for e in (0, 1) for d, k, s, m in PROFILE]
    rows_ += [(0, "push", "CPU A", "by node", 0, 0.25), (1, "push", "CPU A", "by node", 0, 99.0)]
    df = spark.createDataFrame(rows_, "epoch int, direction string, " + schedule.PROFILE_SCHEMA)
    assert [way for way, _ in schedule.push_pull_schedule(df, COUNTS)] == ["push", "pull"]


def test_contiguify_query_and_blocks(spark):
    lanes = schedule.most_gain(table(PROFILE), COUNTS)
    df = spark.createDataFrame(schedule.to_rows(lanes), schedule.SCHEDULE_SCHEMA)
    runs = schedule.contiguify(df)
    want = [(lane.device, i, a, b, k) for i, lane in enumerate(lanes) for a, b, k in schedule.blocks([lane])[0][1]]
    got = [r[:5] for r in rows(runs, "device_id", "seg_start")]
    assert got == want
    assert abs(sum(r.exec_time for r in runs.collect()) - sum(lane.millis for lane in lanes)) < 1e-9
    assert len(schedule.matrix(df).columns) == 1 + len([lane for lane in lanes if lane.tasks])


def test_segment_plan_runs(spark):
    g = make(spark, CYCLE8)
    lanes = schedule.most_gain(table(PROFILE), COUNTS)
    plan = schedule.segment_plan(equal_edge_ranges(g, 6), lanes, {k: k.split()[1] for _, k, _, _ in PROFILE})
    assert rows(g.sssp(0, how=plan)) == rows(g.sssp(0))
    assert schedule.is_gpu("NVIDIA B") and not schedule.is_gpu("CPU A")


def test_benchmarks(spark):
    g = make(spark, CYCLE8)
    rows_ = benchmarks.layer(g, "sssp plain", 2, runs=1)
    assert [r["num_edges"] for r in rows_] == [8, 8] and all(r["gteps"] > 0 for r in rows_)
    assert [r["depth"] for r in benchmarks.tree(g, "pagerank plain", 1, runs=1)] == [0, 1, 1]
    for kernel in ("bfs auto", "sssp broadcast"):
        assert benchmarks.full(g, kernel, runs=1)["millisecs"] > 0
    with pytest.raises(ValueError):
        benchmarks.layer(g, "bfs auto", 1)
    with pytest.raises(ValueError):
        benchmarks.full(g, "nothing")
    assert benchmarks.gteps(4e9, 1000.0) == 2.0
    assert [r["scale"] for r in benchmarks.graph_sizes(spark, [3])] == [3]


def test_command_line(spark, tmp_path, capsys):
    from graphloom.plans import cli
    from graphloom.sources.profiles import read_schedule, to_yaml

    def save(name, device, kernel, times):
        rows_ = [
            {"start_id": i, "end_id": i + 1, "avg_degree": 1.0, "min_degree": 1.0, "max_degree": 1.0, "num_edges": 1, "millisecs": t, "gteps": 1.0, "device_name": device, "kernel_name": kernel}
            for i, t in enumerate(times)
        ]
        (tmp_path / name).write_text(to_yaml(rows_))

    save("a.yaml", "CPU A", "plain", [1.0, 9.0, 9.0])
    save("b.yaml", "NVIDIA B", "warp 64 1024", [9.0, 2.0, 2.0])
    out = tmp_path / "s.skd"
    assert cli.main(["sssp", str(tmp_path / "[ab].yaml"), "-d", "CPU A=1", "-d", "NVIDIA B=1", "-o", str(out)]) == 0
    assert read_schedule(str(out)) == [("CPU A", [(0, 0, "plain")]), ("NVIDIA B", [(1, 2, "warp 64 1024")])]
    save("epoch0_bfs_cpu_push_x.yaml", "CPU A", "by node", [0.5])
    save("epoch0_bfs_gpu_x.yaml", "NVIDIA B", "warp 64 1024", [3.0, 3.0])
    save("epoch0_bfs_cpu_pull.yaml", "CPU A", "pull", [4.0, 4.0])
    assert cli.main(["bfs", str(tmp_path / "epoch*.yaml"), "-d", "CPU A=1", "-d", "NVIDIA B=1", "-o", str(out)]) == 0
    assert read_schedule(str(tmp_path / "s0.skd"))[0] == ("CPU A", [(0, 1, "by node")])
    assert "push" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.device_counts(["CPU"])
