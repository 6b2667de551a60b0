"""The graph: an edge table and a vertex table, with the operators as methods."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public sentinels; inside, what is missing is a missing row.
UNREACHED, INFINITE = -1, float("inf")

EDGE_SCHEMA = "src bigint, dst bigint"
WEIGHTED_EDGE_SCHEMA = "src bigint, dst bigint, w double"


@dataclass
class Graph:
    """Directed entries ``edges`` (src, dst[, w]) over ``vertices`` (id).

    ``symmetric`` says that each entry has its reverse; then an edge's out and in views are one.
    The graph stays lazy until ``prepared`` is asked for, which caches the entries by source.
    """

    edges: DataFrame
    vertices: DataFrame
    symmetric: bool = True
    _cache: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def weighted(self) -> bool:
        return "w" in self.edges.columns

    @classmethod
    def from_edges(cls, edges: DataFrame, symmetrize: bool = True, squish: bool = True, dense: bool = False) -> Graph:
        """Build from (src, dst[, w]) rows.

        Optionally adds reversed entries and drops loops and repeats (the least weight stays).
        ``dense`` makes the vertices all of 0 to the greatest id, else those of ``edges``.
        """
        from graphloom.operators import construct

        vertices = construct.dense_vertices(edges) if dense else construct.end_points(edges)
        out = construct.symmetrize(edges) if symmetrize else edges
        return cls(construct.squish(out) if squish else out, vertices, symmetrize)

    @cached_property
    def num_nodes(self) -> int:
        return self.vertices.count()

    @cached_property
    def num_edges(self) -> int:
        """Directed entries."""
        return self.prepared.count()

    @cached_property
    def partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @cached_property
    def prepared(self) -> DataFrame:
        """``edges`` by hash of ``src`` and sorted by it, cached and filled: joins on it neither move nor sort edges."""
        return self._kept(self.edges.repartition(self.partitions, "src").sortWithinPartitions("src"))

    @cached_property
    def prepared_by_target(self) -> DataFrame:
        """``edges`` by hash of ``dst``: pull steps then aggregate without a shuffle."""
        return self._kept(self.edges.repartition(self.partitions, "dst").sortWithinPartitions("dst"))

    def salted(self, hub_degree: int, salts: int) -> tuple[DataFrame, DataFrame]:
        """(entries with ``_salt`` by hash of source and salt, hubs as (src, _hub)), cached.

        The entries of a source of ``hub_degree`` or more are dealt over ``salts`` values.
        """
        return self._salted("src", "dst", hub_degree, salts)

    def salted_by_target(self, hub_degree: int, salts: int) -> tuple[DataFrame, DataFrame]:
        """The same by target: entries with ``_salt`` by hash of target and salt, hubs as (dst, _hub)."""
        return self._salted("dst", "src", hub_degree, salts)

    def _salted(self, end: str, other: str, hub_degree: int, salts: int) -> tuple[DataFrame, DataFrame]:
        key, name = ("salted", end, hub_degree, salts), ("hubs", end, hub_degree)
        if key not in self._cache:
            degrees = self.edges.groupBy(end).agg(F.count("*").alias("degree"))
            hubs = degrees.filter(F.col("degree") >= hub_degree).select(end, F.lit(True).alias("_hub"))
            edges = self.edges.join(hubs, end, "left")
            edges = edges.withColumn("_salt", F.when(F.col("_hub"), F.pmod(F.hash(other), F.lit(salts))).otherwise(0)).drop("_hub")
            self._cache[key] = edges.repartition(self.partitions, end, "_salt").persist(StorageLevel.MEMORY_AND_DISK)
            self._cache[key].count()
            self._cache[name] = hubs.persist()
        return self._cache[key], self._cache[name]

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, degree) of every vertex, 0 for isolated ones, cached by id."""
        from graphloom.operators import construct

        known = construct.degrees(self.edges)
        all_ = self.vertices.join(known, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
        return self._kept(all_.repartition(self.partitions, "id"))

    def _kept(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        self._cache[id(df)] = df
        return df

    def release(self) -> None:
        """Free every cached table of this graph."""
        for df in self._cache.values():
            df.unpersist()
        self._cache.clear()
        for name in ("prepared", "prepared_by_target", "degrees", "num_edges", "num_nodes"):
            self.__dict__.pop(name, None)

    def unweighted(self) -> Graph:
        return Graph(self.edges.select("src", "dst"), self.vertices, self.symmetric)

    def ordered(self) -> Graph:
        """Vertices renumbered by falling degree; symmetric graphs only."""
        from graphloom.operators import construct

        return construct.relabel_by_degree(self)

    def bfs(self, source: int, **options) -> DataFrame:
        from graphloom.operators.bfs import bfs

        return bfs(self, source, **options)

    def sssp(self, source, **options) -> DataFrame:
        from graphloom.operators.sssp import sssp

        return sssp(self, source, **options)

    def pagerank(self, **options) -> DataFrame:
        from graphloom.operators.pagerank import pagerank

        return pagerank(self, **options)
