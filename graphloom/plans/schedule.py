"""Profile-driven scheduling: which device and kernel takes which segment.

Choosing the best kernel for each device and segment, and the tables about it, are queries over
a profile table. The search itself runs on the driver over one number for each device and
segment, which is a handful whatever the graph's size.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from itertools import pairwise

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.strategies import SegmentPlan

PROFILE_SCHEMA = "device string, kernel string, segment int, millis double"


def best_kernels(profile: DataFrame) -> DataFrame:
    """(device, segment, kernel, millis): the fastest, of equal ones the first by name."""
    least = F.min(F.struct("millis", "kernel")).alias("b")
    return profile.groupBy("device", "segment").agg(least).select("device", "segment", F.col("b.kernel").alias("kernel"), F.col("b.millis").alias("millis"))


def gains(profile: DataFrame) -> DataFrame:
    """(segment, device_from, device_to, gain): time on the other device for each unit on this one."""
    best = best_kernels(profile)
    one = best.select("segment", F.col("device").alias("device_from"), F.col("millis").alias("_from"))
    two = best.select("segment", F.col("device").alias("device_to"), F.col("millis").alias("_to"))
    return one.join(two, "segment").select("segment", "device_from", "device_to", (F.col("_to") / F.col("_from")).alias("gain"))


def device_times(profile: DataFrame) -> DataFrame:
    """(device, millis): all segments on one device."""
    return best_kernels(profile).groupBy("device").agg(F.sum("millis").alias("millis"))


def best_single_device(profile: DataFrame) -> DataFrame:
    """One row (device, millis): the fastest device alone, of equal ones the first by name."""
    least = device_times(profile).agg(F.min(F.struct("millis", "device")).alias("b"))
    return least.select(F.col("b.device").alias("device"), F.col("b.millis").alias("millis"))


def on_hardware(profile: DataFrame, counts: dict[str, int]) -> DataFrame:
    """The profiles of devices of which there is one at least."""
    return profile.filter(F.col("device").isin([d for d, n in counts.items() if n > 0]))


@dataclass(frozen=True)
class Task:
    """A segment on a device by a kernel."""

    segment: int
    kernel: str
    millis: float


@dataclass(frozen=True)
class Lane:
    """One processor: a device's name and its tasks by segment."""

    device: str
    tasks: tuple[Task, ...] = ()

    @property
    def millis(self) -> float:
        return sum(t.millis for t in self.tasks)

    def without(self, task: Task) -> Lane:
        return replace(self, tasks=tuple(t for t in self.tasks if t != task))

    def with_(self, task: Task) -> Lane:
        return replace(self, tasks=tuple(sorted((*self.tasks, task), key=lambda t: t.segment)))


Costs = dict[str, dict[int, Task]]


def costs(profile: DataFrame) -> Costs:
    """Best task of each device and segment, on the driver."""
    out: Costs = {}
    for r in best_kernels(profile).orderBy("device", "segment").collect():
        out.setdefault(r.device, {})[r.segment] = Task(r.segment, r.kernel, r.millis)
    return out


def metric(lanes: Iterable[Lane]) -> tuple[float, float, float]:
    """(longest, total, squared distances from the longest), compared in that order; less is better."""
    times = [lane.millis for lane in lanes]
    longest = max(times)
    return longest, sum(times), sum((longest - t) ** 2 for t in times)


def worst_time(lanes: Iterable[Lane]) -> float:
    return max(lane.millis for lane in lanes)


def speed_up(lanes: Iterable[Lane], single: float) -> float:
    """How many times faster than the best single device."""
    return single / worst_time(lanes)


def even_out(lanes: list[Lane]) -> list[Lane]:
    """Processors of one device after tasks moved between neighbours, each move nearer to the mean.

    Going right, last tasks move to the next processor; going left, first tasks to the one
    before, so ranges stay contiguous.
    """
    lanes = list(lanes)
    mean = sum(lane.millis for lane in lanes) / len(lanes)
    spread = lambda a, b: (a.millis - mean) ** 2 + (b.millis - mean) ** 2
    steps = [*((i, j, -1) for i, j in pairwise(range(len(lanes)))), *((j, i, 0) for i, j in reversed(list(pairwise(range(len(lanes))))))]
    for giver, taker, end in steps:
        while lanes[giver].tasks:
            task = lanes[giver].tasks[end]
            less, more = lanes[giver].without(task), lanes[taker].with_(task)
            if spread(less, more) >= spread(lanes[giver], lanes[taker]):
                break
            lanes[giver], lanes[taker] = less, more
    return lanes


def _deal(tasks: list[Task], device: str, count: int) -> list[Lane]:
    """Contiguous shares of about equal time; the last processor takes what is left."""
    share, lanes, rest = sum(t.millis for t in tasks) / count, [], list(tasks)
    for n in range(count):
        lane = Lane(device)
        while rest and (n == count - 1 or lane.millis < share):
            lane = lane.with_(rest.pop(0))
        lanes.append(lane)
    return lanes


def _improved(by_device: dict[str, list[Lane]], table: Costs) -> dict[str, list[Lane]] | None:
    """One segment off the slowest device, if that shortens the longest time; else None.

    Other devices are tried from the least busy on; each is offered the segment that it does
    best in relation to the slowest one.
    """
    busy = sorted((sum(lane.millis for lane in lanes) / len(lanes), device) for device, lanes in by_device.items())
    slow, before = busy[-1][1], worst_time(lane for lanes in by_device.values() for lane in lanes)
    owned = sorted(((t.segment, i, t) for i, lane in enumerate(by_device[slow]) for t in lane.tasks), key=lambda x: x[:2])
    for _, other in busy[:-1]:
        usable = [x for x in owned if x[0] in table[other]]
        if not usable:
            continue
        segment, giver, task = min(usable, key=lambda x: (table[other][x[0]].millis / table[slow][x[0]].millis, x[0]))
        taker = 0
        for i, lane in enumerate(by_device[other]):
            if any(t.segment < segment for t in lane.tasks):
                taker = i
        moved = dict(by_device)
        moved[slow] = even_out([lane.without(task) if i == giver else lane for i, lane in enumerate(by_device[slow])])
        moved[other] = even_out([lane.with_(table[other][segment]) if i == taker else lane for i, lane in enumerate(by_device[other])])
        if worst_time(lane for lanes in moved.values() for lane in lanes) < before:
            return moved
    return None


def most_gain(table: Costs, counts: dict[str, int]) -> list[Lane]:
    """A schedule for ``counts`` processors of each device.

    The device that is fastest alone takes everything in contiguous shares; then segments move
    one at a time from the busiest device to others while the longest time shrinks.
    """
    counts = {d: n for d, n in counts.items() if n > 0}
    missing = [d for d in counts if d not in table]
    if not counts or missing:
        raise ValueError(f"no profile for {missing}" if missing else "no device")
    first = min(counts, key=lambda d: (sum(t.millis for t in table[d].values()), list(counts).index(d)))
    by_device = {d: [Lane(d)] * n for d, n in counts.items()}
    by_device[first] = even_out(_deal([table[first][s] for s in sorted(table[first])], first, counts[first]))
    while (better := _improved(by_device, table)) is not None:
        by_device = better
    return [lane for lanes in by_device.values() for lane in lanes]


def exhaustive(profile_rows: Iterable[tuple[str, str, int, float]], counts: dict[str, int]) -> list[Lane]:
    """The best schedule by ``metric`` over every kernel and processor of each segment.

    Exponential in the segments: for tests and small cases.
    """
    options: dict[int, list[tuple[str, Task]]] = {}
    for device, kernel, segment, millis in profile_rows:
        if counts.get(device, 0) > 0:
            options.setdefault(segment, []).append((device, Task(segment, kernel, millis)))
    partial: list[list[Lane]] = [[Lane(d) for d, n in counts.items() for _ in range(n)]]
    for segment in sorted(options):
        nxt = {}
        for lanes in partial:
            for device, task in options[segment]:
                for i, lane in enumerate(lanes):
                    if lane.device == device:
                        new = [*lanes[:i], lane.with_(task), *lanes[i + 1 :]]
                        nxt.setdefault(tuple((x.device, x.tasks) for x in new), new)
        partial = list(nxt.values())
    return min(partial, key=metric)


def push_or_pull(push: list[tuple[str, str, float]], pull: Costs, counts: dict[str, int]) -> tuple[str, list[Lane]]:
    """One level's schedule: the best pull schedule, or the fastest single push kernel if it is faster.

    ``push`` has (device, kernel, millis) of whole levels. A push level runs on one processor,
    its time spread evenly over the segments; the other processors idle.
    """
    lanes = most_gain(pull, counts)
    fastest = min(push, key=lambda p: (p[2], p[1]), default=None)
    if fastest is None or fastest[2] >= worst_time(lanes):
        return "pull", lanes
    device, kernel, millis = fastest
    segments = sorted(next(iter(pull.values())))
    busy = Lane(device, tuple(Task(s, kernel, millis / len(segments)) for s in segments))
    idle = [Lane(d) for d, n in counts.items() for _ in range(n - (d == device))]
    return "push", [busy, *idle]


def push_pull_schedule(profiles: DataFrame, counts: dict[str, int]) -> list[tuple[str, list[Lane]]]:
    """``push_or_pull`` for each epoch of (epoch, direction, device, kernel, segment, millis)."""
    out = []
    for (epoch,) in profiles.select("epoch").distinct().orderBy("epoch").collect():
        own = profiles.filter(F.col("epoch") == epoch)
        push = own.filter("direction = 'push'").groupBy("device", "kernel").agg(F.min_by("millis", "segment").alias("millis"))
        pull = on_hardware(own.filter("direction = 'pull'"), counts)
        rows = [(r.device, r.kernel, r.millis) for r in push.orderBy("device", "kernel").collect()]
        out.append(push_or_pull(rows, costs(pull), counts))
    return out


SCHEDULE_SCHEMA = "device string, device_id int, segment int, kernel string, millis double"


def to_rows(lanes: list[Lane]) -> list[tuple[str, int, int, str, float]]:
    return [(lane.device, i, t.segment, t.kernel, t.millis) for i, lane in enumerate(lanes) for t in lane.tasks]


def contiguify(schedule: DataFrame) -> DataFrame:
    """(device, device_id, seg_start, seg_end, kernel, exec_time): runs of one kernel, inclusive.

    ``schedule`` has SCHEDULE_SCHEMA. A run's time is the sum of its segments'.
    """
    order = Window.partitionBy("device_id", "kernel").orderBy("segment")
    runs = schedule.withColumn("_run", F.col("segment") - F.row_number().over(order))
    return runs.groupBy("device", "device_id", "kernel", "_run").agg(
        F.min("segment").alias("seg_start"), F.max("segment").alias("seg_end"), F.sum("millis").alias("exec_time")
    ).select("device", "device_id", "seg_start", "seg_end", "kernel", "exec_time")


def blocks(lanes: list[Lane]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The lanes as a schedule file has them: inclusive ranges of one kernel."""
    out = []
    for lane in lanes:
        runs: list[tuple[int, int, str]] = []
        for t in lane.tasks:
            if runs and runs[-1][2] == t.kernel and runs[-1][1] + 1 == t.segment:
                runs[-1] = (runs[-1][0], t.segment, t.kernel)
            else:
                runs.append((t.segment, t.segment, t.kernel))
        out.append((lane.device, runs))
    return out


def matrix(schedule: DataFrame) -> DataFrame:
    """(segment, one column for each processor): the kernel that it runs there."""
    ids = [r.device_id for r in schedule.select("device_id").distinct().orderBy("device_id").collect()]
    return schedule.groupBy("segment").pivot("device_id", ids).agg(F.first("kernel")).orderBy("segment")


def is_gpu(device: str) -> bool:
    return device.startswith("NVIDIA")


def segment_plan(ranges: DataFrame, lanes: list[Lane], kernels: dict[str, str]) -> SegmentPlan:
    """The strategies that a schedule names, over the id ranges (segment, start_id, end_id).

    ``kernels`` maps kernel names to strategies. This is what a schedule compiles to: one
    strategy for each segment, run together in every epoch.
    """
    bounds = {r.segment: (r.start_id, r.end_id) for r in ranges.collect()}
    rows = [(*bounds[t.segment], kernels[t.kernel]) for lane in lanes for t in lane.tasks]
    return SegmentPlan.of([r for r in rows if r[0] < r[1]])
