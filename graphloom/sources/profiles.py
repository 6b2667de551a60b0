"""Benchmark profiles as YAML text, and schedules as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[-+0-9.eE]+|inf|nan"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(device, kernel, segment, millis) of layer profiles: one file or a pattern of files.

    Only each file's first result counts, as a layer has one.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    millis = F.regexp_extract_all("t", F.lit(rf"(?m)^\s+millis: ({NUMBER})\s*$"), F.lit(1))
    named = text.select(
        F.trim(F.regexp_extract("t", r"(?m)^\s+device: (.*)$", 1)).alias("device"),
        F.trim(F.regexp_extract("t", r"(?m)^\s+kernel: (.*)$", 1)).alias("kernel"),
        F.posexplode(millis).alias("segment", "millis"),
    )
    return named.select("device", "kernel", "segment", F.col("millis").cast("double").alias("millis"))


def read_epoch_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, direction, device, kernel, segment, millis) of search profiles.

    Epoch and direction are in the file name, ``epoch{E}_bfs_{cpu|gpu}_{kind}``: files of GPUs
    are pull profiles, those of CPUs are what their kind says.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"), F.col("_metadata.file_name").alias("f"))
    millis = F.regexp_extract_all("t", F.lit(rf"(?m)^\s+millis: ({NUMBER})\s*$"), F.lit(1))
    kind = F.regexp_extract("f", r"^epoch\d+_[^_]*_(?:gpu|cpu_push)", 0)
    return text.select(
        F.regexp_extract("f", r"^epoch(\d+)_", 1).cast("int").alias("epoch"),
        F.when(kind.endswith("push"), "push").otherwise("pull").alias("direction"),
        F.trim(F.regexp_extract("t", r"(?m)^\s+device: (.*)$", 1)).alias("device"),
        F.trim(F.regexp_extract("t", r"(?m)^\s+kernel: (.*)$", 1)).alias("kernel"),
        F.posexplode(millis).alias("segment", "millis"),
    ).withColumn("millis", F.col("millis").cast("double"))


FIELDS = (
    ("start", "start_id"), ("end", "end_id"), ("avg_deg", "avg_degree"), ("min_deg", "min_degree"),
    ("max_deg", "max_degree"), ("num_edges", "num_edges"), ("millis", "millisecs"), ("gteps", "gteps"),
)


def _number(x) -> str:
    return format(x, ".10g") if isinstance(x, float) else str(x)


def _segment(row: dict, pad: str) -> list[str]:
    lines = [f"{name}: {_number(row[key])}" for name, key in FIELDS]
    return [f"{pad}- {lines[0]}", *[f"{pad}  {line}" for line in lines[1:]]]


def to_yaml(rows: list[dict], shape: str = "layer") -> str:
    """Benchmark rows of one device and kernel as text: a segment, a layer, or a tree of layers."""
    if not rows:
        raise ValueError("no rows")
    out = ["config:", f"  device: {rows[0]['device_name']}", f"  kernel: {rows[0]['kernel_name']}", "results:"]
    if shape == "segment":
        out += _segment(rows[0], "  ")
    elif shape == "layer":
        out.append("  - segments:")
        for row in rows:
            out += _segment(row, "      ")
    elif shape == "tree":
        for depth in sorted({r["depth"] for r in rows}):
            out += [f"  - depth: {depth}", "    segments:"]
            for row in rows:
                if row["depth"] == depth:
                    out += _segment(row, "      ")
    else:
        raise ValueError(f"no shape {shape!r}")
    return "\n".join(out) + "\n"


def write_schedule(schedule: list[tuple[str, list[tuple[int, int, str]]]], path: str) -> None:
    """(device, [(first, last, kernel)]) blocks: a device line, then two lines for each range."""
    with open(path, "w", encoding="utf-8") as f:
        for device, ranges in schedule:
            f.write(f"{device}\n")
            for first, last, kernel in ranges:
                f.write(f"{first} {last}\n{kernel}\n")


def read_schedule(path: str) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The blocks of a schedule file; ranges are inclusive. ValueError where one lacks its kernel."""
    with open(path, encoding="utf-8") as f:
        lines = [line.strip() for line in f if line.strip()]
    out: list[tuple[str, list[tuple[int, int, str]]]] = []
    at = 0
    while at < len(lines):
        words = lines[at].split()
        if len(words) == 2 and all(w.isdigit() for w in words):
            if not out or at + 1 >= len(lines):
                raise ValueError(f"{path}: a range without device or kernel")
            out[-1][1].append((int(words[0]), int(words[1]), lines[at + 1]))
            at += 2
        else:
            out.append((lines[at], []))
            at += 1
    return out


def parse_kernel(column) -> F.Column:
    """struct<name,blocks,threads> of a kernel text; the two counts are null where they are missing."""
    text = F.trim(column)
    count = lambda i: F.regexp_extract(text, r"^(.*\S)\s+(\d+)\s+(\d+)$", i)
    has = count(2) != ""
    return F.struct(
        F.when(has, count(1)).otherwise(text).alias("name"),
        F.when(has, count(2).cast("int")).alias("blocks"),
        F.when(has, count(3).cast("int")).alias("threads"),
    )
