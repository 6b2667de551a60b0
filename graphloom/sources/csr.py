"""Binary CSR files: a Python data source with splits by entry, and a parallel writer.

Layout, little-endian: int32 N, int64 E, int64[N + 1] row starts, then E entries of int32 v and,
in weighted files (.wsg), float32 w. Bytes after the last entry are ignored and never written.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.model import EDGE_SCHEMA, WEIGHTED_EDGE_SCHEMA, Graph
from graphloom.operators.construct import csr_index

HEAD = struct.Struct("<iq")
HEAD_BYTES = 12
ENTRY = {True: np.dtype([("v", "<i4"), ("w", "<f4")]), False: np.dtype([("v", "<i4")])}
#: Entries in a split, in a batch that a reader yields, and ids in a step through the row starts.
SPLIT, BATCH = 1 << 22, 1 << 16


def is_weighted(path: str) -> bool:
    if path.endswith(".wsg"):
        return True
    if path.endswith(".sg"):
        return False
    raise ValueError(f"{path}: a CSR file ends in .wsg or .sg")


def header(path: str) -> tuple[int, int]:
    """(N, E) of a file; ValueError if it is shorter than they say."""
    with open(path, "rb") as f:
        raw = f.read(HEAD_BYTES)
    if len(raw) < HEAD_BYTES:
        raise ValueError(f"{path}: no header")
    nodes, entries = HEAD.unpack(raw)
    need = HEAD_BYTES + 8 * (nodes + 1) + ENTRY[is_weighted(path)].itemsize * entries
    if nodes < 0 or entries < 0 or os.path.getsize(path) < need:
        raise ValueError(f"{path}: shorter than its header says")
    return nodes, entries


class Entries(InputPartition):
    def __init__(self, first: int, stop: int):
        super().__init__((first, stop))
        self.first, self.stop = first, stop


class CsrReader(DataSourceReader):
    """Each split reads its own entries and the row starts around them, by seeking."""

    def __init__(self, path: str):
        self.path, self.weighted = path, is_weighted(path)
        self.nodes, self.entries = header(path)

    def partitions(self) -> list[Entries]:
        return [Entries(a, min(a + SPLIT, self.entries)) for a in range(0, self.entries, SPLIT)] or [Entries(0, 0)]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.stop:
            return
        starts = np.memmap(self.path, "<i8", "r", HEAD_BYTES, (self.nodes + 1,))
        kind = ENTRY[self.weighted]
        at = HEAD_BYTES + 8 * (self.nodes + 1)
        for first in range(partition.first, partition.stop, BATCH):
            stop = min(first + BATCH, partition.stop)
            low = int(np.searchsorted(starts, first, side="right")) - 1
            high = int(np.searchsorted(starts, stop, side="left"))
            bounds = np.clip(np.asarray(starts[low : high + 1]), first, stop)
            source = np.repeat(np.arange(low, low + len(bounds) - 1), np.diff(bounds))
            with open(self.path, "rb") as f:
                f.seek(at + kind.itemsize * first)
                rows = np.frombuffer(f.read(kind.itemsize * (stop - first)), kind)
            columns = [pa.array(source), pa.array(rows["v"].astype(np.int64))]
            names = ["src", "dst"]
            if self.weighted:
                columns.append(pa.array(rows["w"].astype(np.float64)))
                names.append("w")
            yield pa.RecordBatch.from_arrays(columns, names=names)


class CsrSource(DataSource):
    """``spark.read.format("csr").load(path)``: (src, dst[, w]) of a .wsg or .sg file.

    The path must be one that every executor can open.
    """

    @classmethod
    def name(cls) -> str:
        return "csr"

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("a CSR source needs a path")
        return self.options["path"].removeprefix("file://")

    def schema(self) -> str:
        return WEIGHTED_EDGE_SCHEMA if is_weighted(self._path()) else EDGE_SCHEMA

    def reader(self, schema) -> CsrReader:
        return CsrReader(self._path())


def load_csr(spark: SparkSession, path: str, symmetric: bool = True) -> Graph:
    """The graph of a file, with all its N vertices."""
    spark.dataSource.register(CsrSource)
    nodes, _ = header(path)
    return Graph(spark.read.format("csr").load(path), spark.range(nodes), symmetric)


def write_csr(graph: Graph, path: str) -> None:
    """Write a graph whose ids are 0 to N - 1 as one file, by all tasks at once.

    The driver sizes the file; each task writes the bytes of its own sorted range of sources to
    their place, so a task that runs twice writes the same. Entries are sorted by (src, dst).
    The folder must be shared by all executors. Weights become 32-bit floats.
    """
    weighted = is_weighted(path)
    if weighted and not graph.weighted:
        raise ValueError("a .wsg file needs weights")
    index = csr_index(graph).persist()
    nodes, top, entries = index.agg(F.count("*"), F.coalesce(F.max("id"), F.lit(-1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
    if top + 1 != nodes or nodes > 2**31 - 1:
        raise ValueError("ids must be 0 to N - 1, and N at most 2^31 - 1")
    kind, at = ENTRY[weighted], HEAD_BYTES + 8 * (nodes + 1)
    with open(path, "wb") as f:
        f.write(HEAD.pack(nodes, entries))
        f.truncate(at + kind.itemsize * entries)
        f.seek(HEAD_BYTES + 8 * nodes)
        f.write(struct.pack("<q", entries))

    def put(batches, places, size):
        wrote = 0
        with open(path, "r+b") as f:
            for batch in batches:
                position, data = places(batch)
                edges = np.flatnonzero(np.diff(position) != 1) + 1
                for part, own in zip(np.split(position, edges), np.split(data, edges), strict=True):
                    if len(part):
                        f.seek(size[0] + size[1] * int(part[0]))
                        f.write(own.tobytes())
                        wrote += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([wrote], pa.int64())], names=["n"])

    def starts(batch):
        return batch.column("id").to_numpy(), batch.column("offset").to_numpy().astype("<i8")

    def rows(batch):
        rows = np.empty(batch.num_rows, kind)
        rows["v"] = batch.column("dst").to_numpy()
        if weighted:
            rows["w"] = batch.column("w").to_numpy()
        return batch.column("position").to_numpy(), rows

    done = index.repartitionByRange("id").sortWithinPartitions("id")
    done.mapInArrow(lambda b: put(b, starts, (HEAD_BYTES, 8)), "n long").agg(F.sum("n")).collect()


    order = Window.partitionBy("src").orderBy("dst")
    columns = ["position", "dst", *(["w"] if weighted else [])]
    placed = graph.edges.join(index.select(F.col("id").alias("src"), "offset"), "src")
    placed = placed.withColumn("position", F.col("offset") + F.row_number().over(order) - 1)
    wrote = placed.select(*columns).mapInArrow(lambda b: put(b, rows, (at, kind.itemsize)), "n long").agg(F.sum("n")).first()[0]
    index.unpersist()
    if (wrote or 0) != entries:
        raise RuntimeError(f"wrote {wrote} of {entries} entries")


