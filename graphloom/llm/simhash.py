"""SimHash near-duplicate detection with BK-trees over shards of fingerprints.

Links join fingerprints at ``radius`` or fewer differing bits. By the pigeonhole principle two
such fingerprints agree on at least ``blocks - radius`` of ``blocks`` bit blocks, so sharding
each fingerprint by every choice of that many blocks brings each linked pair together in some
shard. Each shard's distinct fingerprints form one BK-tree in the task that has the shard, and its
fingerprints are the queries: they follow only edges within the radius, and the shard emits a
star for each component that it finds, never pairs. The queries of a shard over ``SPLIT`` values
are dealt over several tasks, each with the shard's tree. Trees go to their queries by the
shuffle that makes the shards; to broadcast them they would have to be collected on the driver.
Exact copies collapse to one fingerprint before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import annotate, quoted
from graphloom.llm.bktree import BKTree
from graphloom.llm.graph import connected_components
from graphloom.llm.storage import cut, written

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Expected values in a shard above which shards get another block, and so more key bits.
SHARD_VALUES = 4096
#: Queries of one shard that a task takes; a shard with more goes to several tasks.
SPLIT = 1 << 16
#: Row numbers that may be broadcast, some 30 MB.
BROADCAST_ROWS = 1_000_000

#: Fingerprints that may be too frequent for one task: those of over this share of all rows.
HOT = 1000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> bytes:
    """8 bytes, most significant bit first; a bit is 1 if set in over half the shingle hashes."""
    words = text.translate(LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 16):
        ones += bits[at : at + (1 << 16)].sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _annotator(shingle_words: int, seed: int):
    def make():
        def run(texts: pa.Array):
            prints = b"".join(fingerprint(t or b"", shingle_words, seed) for t in texts.cast(pa.binary()).to_pylist())
            return [pa.array(np.frombuffer(prints, dtype=">i8").astype(np.int64))]

        return run

    return make


def fingerprints(df: DataFrame, text_col: str = "text", keep=None, name: str = "fp", shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``df`` with a signed 64-bit SimHash of ``text_col``; null and word-less texts get 0."""
    return annotate(df, text_col, _annotator(shingle_words, seed), [(name, T.LongType())], keep=keep)


def _shard_keys(fp: str, radius: int, blocks: int):
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(n).cast("long")
        for b in chosen:
            width = cuts[b + 1] - cuts[b]
            part = F.shiftrightunsigned(F.col(fp), cuts[b]).bitwiseAND((1 << width) - 1)
            value = F.shiftleft(value, width).bitwiseOR(part)
        keys.append(value)
    return F.array(*keys)


def _stars(radius: int):
    """Over rows (key, fp, own) sorted by key: (a, b) with a the least fingerprint of b's component.

    Only the values that are ``own`` are queries.
    """

    def shard(values: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, first = np.unique(values, return_index=True)
        top = BKTree(values.view(np.uint64)).components(radius, np.flatnonzero(own[first]))
        rest = top != np.arange(len(top))
        return values[top[rest]], values[rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the rows of the last key, which may go on in the next batch

        def found(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            keys, values, own = (np.concatenate(c) for c in zip(*rows, strict=True))
            edges = np.flatnonzero(np.diff(keys)) + 1
            parts = zip(np.split(values, edges), np.split(own, edges), strict=True)
            pairs = [shard(v, o) for v, o in parts if len(v) > 1] or [(np.empty(0, np.int64),) * 2]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs, strict=True)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            start = int(np.searchsorted(rows[0], rows[0][-1]))
            if start or (held and held[-1][0][-1] != rows[0][-1]):
                yield found([*held, tuple(c[:start] for c in rows)])
                held = []
            held.append(tuple(c[start:] for c in rows))
        if held:
            yield found(held)

    return run


def links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, split: int = SPLIT) -> DataFrame:
    """Star links (a, b) over distinct fingerprints ``fp``; together they connect every component.

    ``blocks`` defaults to the fewest (at least ``radius + 1``) that keep shards of evenly
    spread fingerprints under ``SHARD_VALUES``; it and ``split`` change the cost and never the result.
    """
    spark = prints.sparkSession
    if blocks is None:
        count, blocks = prints.count(), radius + 1
        while blocks < radius + 4 and count / 2 ** (64 * (blocks - radius) // blocks) > SHARD_VALUES:
            blocks += 1
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select(F.explode(_shard_keys("fp", radius, blocks)).alias("key"), "fp")
    big = keyed.groupBy("key").count().filter(F.col("count") > split).select("key", F.ceil(F.col("count") / split).cast("int").alias("ways"))
    keyed = keyed.join(F.broadcast(big), "key", "left")  # one row for each ``split`` rows at most
    keyed = keyed.select("key", "fp", "ways", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)).alias("salt"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("ways", F.lit(1))) == F.col("salt")
    # The salt is part of the number, so that a task with two shares of a shard keeps them apart.
    keyed = keyed.select(F.when(F.col("ways").isNull(), F.col("key")).otherwise(F.xxhash64("key", "salt")).alias("key"), "fp", own.alias("own"))
    keyed = keyed.repartition(tasks, "key").sortWithinPartitions("key")
    return keyed.mapInArrow(_stars(radius), "a long, b long")


def _classes(rows: DataFrame, radius: int, blocks: int | None) -> DataFrame:
    """Stored ``rows`` (id, fp, ...) with root and component_id: root is a component's least fingerprint.

    The rows of a fingerprint with over 1/HOT of all rows are dealt over several tasks when
    they meet their class; there are at most HOT such fingerprints.
    """
    least = cut(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    total = least.agg(F.sum("n")).first()[0] or 0
    nodes = connected_components(links(least.select("fp"), radius, blocks))
    members = nodes.withColumnRenamed("node", "fp").join(least, "fp")
    names = members.groupBy("root").agg(F.min("rep").alias("name"))
    named = members.select("fp", "root").join(names, "root")
    classes = least.join(named, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("name", "rep").alias("component_id")
    )
    share = max(1, total // HOT)
    hot = F.broadcast(least.filter(F.col("n") > share).select("fp", F.ceil(F.col("n") / share).cast("int").alias("ways")))
    # The rows come from storage, so their numbers are the same if a task runs again.
    salted = rows.withColumn("salt", F.monotonically_increasing_id()).join(hot, "fp", "left")
    salted = salted.withColumn("salt", F.coalesce(F.pmod("salt", "ways"), F.lit(0)).cast("int")).drop("ways")
    ways = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / share), F.lit(1)).cast("int") - 1)
    spread = classes.withColumn("salt", F.explode(F.when(F.col("n") > share, ways).otherwise(F.array(F.lit(0))))).drop("n")
    return salted.join(spread, ["fp", "salt"]).drop("salt")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(id, fp, component_id) for each row of ``df``; component_id is the least id reachable.

    Rows without words (null, empty or blank texts) have fingerprint zero and link like any other.
    A null id is kept: its row still links others, but names a component only if no id in it is
    known (then null). Repeated ids and rows give as many rows as they have. An empty table gives
    no rows. Texts of any length are taken whole; other columns may have any names.
    """
    rows = cut(fingerprints(df, text_col, keep=[id_col]).toDF("id", "fp"))
    return _classes(rows, radius, blocks).select("id", "fp", "component_id").toDF(id_col, "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each component: that of the least id, all columns kept.

    A row without an id stays only where its component has no id at all; an empty id is an id. Of
    several rows with that id the least fingerprint stays, then the least hash of the text, then
    the first row. Null and blank texts are one component; an empty table stays empty.

    Rows are stored once with their fingerprints; only their numbers, ids and hashes move. The
    numbers of the rows that go are broadcast if there are no more than BROADCAST_ROWS.
    """
    columns = df.columns
    tagged = fingerprints(df, text_col).toDF(*[f"c{i}" for i in range(len(columns))], "fp")
    stored = written(tagged.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    rows = stored.select("row", F.col(f"c{columns.index(id_col)}").alias("id"), "fp", F.xxhash64(f"c{columns.index(text_col)}").alias("h"))
    found = cut(_classes(rows, radius, None).select("row", "root", "id", "fp", "h"))
    heads = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "fp", "h", "row")).alias("head"))
    gone = cut(found.select("row").join(heads.select("head.row"), "row", "left_anti"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = stored.join(gone, "row", "left_anti")
    return kept.select(*[f"c{i}" for i in range(len(columns))]).toDF(*columns)


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
