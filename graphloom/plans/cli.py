"""Command line: profiles to a schedule file, for each of the three algorithms."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.plans import schedule
from graphloom.sources.profiles import read_epoch_profiles, read_profiles, write_schedule


def device_counts(pairs: list[str]) -> dict[str, int]:
    """``name=count`` arguments; ValueError for one that is not."""
    out: dict[str, int] = {}
    for pair in pairs:
        name, sign, count = pair.rpartition("=")
        if not sign or not name or not count.isdigit():
            raise ValueError(f"{pair!r} is not name=count")
        if int(count):
            out[name] = int(count)
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Schedule segments on devices by measured profiles.")
    parser.add_argument("algorithm", choices=("bfs", "sssp", "pr"))
    parser.add_argument("profiles", help="a profile file or a pattern of them")
    parser.add_argument("-d", "--device", action="append", default=[], metavar="NAME=COUNT")
    parser.add_argument("-o", "--out", default="schedule.skd", help="for bfs, the epoch goes before the ending")
    args = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    counts = device_counts(args.device)
    if args.algorithm == "bfs":
        stem, dot, ending = args.out.rpartition(".")
        for epoch, (way, lanes) in enumerate(schedule.push_pull_schedule(read_epoch_profiles(spark, args.profiles), counts)):
            write_schedule(schedule.blocks(lanes), f"{stem or ending}{epoch}{dot}{ending if stem else ''}")
            print(f"epoch {epoch}: {way}, worst device time {schedule.worst_time(lanes):.6g} ms")
        return 0
    profile = schedule.on_hardware(read_profiles(spark, args.profiles), counts)
    lanes = schedule.most_gain(schedule.costs(profile), counts)
    single = schedule.best_single_device(profile).first().millis
    write_schedule(schedule.blocks(lanes), args.out)
    spark.createDataFrame(schedule.to_rows(lanes), schedule.SCHEDULE_SCHEMA).transform(schedule.matrix).show(1000, truncate=False)
    print(f"worst device time {schedule.worst_time(lanes):.6g} ms, {schedule.speed_up(lanes, single):.3g} times the best device alone")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
