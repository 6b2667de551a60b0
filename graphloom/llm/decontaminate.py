"""Benchmark decontamination with an Aho-Corasick automaton over normalised item windows.

Texts are normalised to lower-case ASCII words joined by single spaces. Every run of ``window``
item words (or a shorter item's whole words) is one pattern. The automaton runs over two symbols
for each item word in place of the word's characters, with a third of the nodes. Each document
is scanned once and its hits are mapped back to word positions and to character offsets of the
original text.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import annotate, quoted
from graphloom.llm.storage import cut, written

WINDOW = 10
#: Item text bytes for one automaton and one broadcast; more items take a pass for each such shard.
SHARD_BYTES = 2 << 20
#: Rows of documents with hits that may be broadcast to meet the others.
BROADCAST_ROWS = 100_000

#: A-Z to a-z, digits, a-z and bytes of non-ASCII characters as they are, all else to space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Patterns of a set of items; ``scan`` gives the (first word, last word, items) of each hit.

    A word's number is written as a high and a low symbol of two alphabets, so a hit can only
    begin at a word; words of no item are two symbols that no pattern has.
    """

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        numbers: dict[bytes, int] = {}
        texts = [(item, [numbers.setdefault(w, len(numbers)) for w in words_of(text)]) for item, text in items]
        base = math.isqrt(len(numbers)) + 1
        self.symbols = {w: chr(1 + n // base) + chr(1 + base + n % base) for w, n in numbers.items()}
        symbols, values = list(self.symbols.values()), {}
        self.machine = ahocorasick.Automaton()
        for item, words in texts:
            k = min(window, len(words))
            text = "".join([symbols[n] for n in words])
            for i in range(len(words) - k + 1 if k else 0):
                key = text[2 * i : 2 * (i + k)]
                names = self.machine.get(key, (k, frozenset()))[1]
                if item not in names:
                    value = (k, names | {item})
                    self.machine.add_word(key, values.setdefault(value, value))
        self.empty = not values
        if values:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, frozenset]]:
        if self.empty or not words:
            return []
        symbols = self.symbols.get
        text = "".join([symbols(w, "\0\0") for w in words])
        return [(end // 2 - k + 1, end // 2, items) for end, (k, items) in self.machine.iter(text)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted inclusive ranges, with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as character spans of the original text, end exclusive."""
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[a][0], "end": places[b][1]} for a, b in ranges]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("items", T.ArrayType(T.StringType())),
    ("spans", SPANS),
]


def _pieces(text: bytes, window: int, limit: int):
    """``text`` if it has ``limit`` bytes at most, else runs of its words of about that size with the same windows."""
    words = words_of(text) if len(text) > limit else []
    if len(words) <= window:
        yield b" ".join(words) or text
        return
    step = max(1, len(words) * limit // len(text))
    for at in range(0, len(words) - window + 1, step):
        yield b" ".join(words[at : at + step + window - 1])


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int, shard_bytes: int):
    """The items in shards of about ``shard_bytes``, pulled one partition at a time."""
    rows = benchmark.select(F.col(quoted(item_col)).cast("string"), F.col(quoted(text_col)).cast("string"))
    rows = rows.toDF("item", "text").filter(F.col("text").isNotNull())
    shard, size = [], 0
    for item, text in rows.toLocalIterator():
        for data in _pieces(text.encode("utf-8"), window, shard_bytes):
            if shard and size + len(data) > shard_bytes:
                yield shard
                shard, size = [], 0
            shard.append((item, data))
            size += len(data)
    yield shard


def _summary(found: list[tuple[int, int, frozenset]]) -> tuple[list[tuple[int, int]], list]:
    """The merged word ranges of hits, and their items: sorted, null last."""
    names = set().union(*[s for _, _, s in found])
    return merged([(a, b) for a, b, _ in found]), sorted(names - {None}) + [None] * (None in names)


def _scanner(shard, window: int):
    """An annotator that gives FIELDS."""

    def make():
        machine = Automaton(shard.value, window)

        def run(texts: pa.Array):
            data = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
            words = [words_of(t) for t in data]
            found = [_summary(machine.scan(w)) for w in words]
            spans = [offsets(text.decode("utf-8"), ranges) if ranges else [] for text, (ranges, _) in zip(data, found, strict=True)]
            return [
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([sum(b - a + 1 for a, b in ranges) for ranges, _ in found], pa.int64()),
                pa.array([items for _, items in found], pa.list_(pa.string())),
                pa.array(spans, _SPANS),
            ]

        return run

    return make


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RANGES = pa.list_(pa.struct([(n, pa.int32()) for n in ("a", "b", "start", "end")]))


def _ranges_of(shard, window: int):
    """An annotator that gives the merged ranges of hits as words and characters, and items."""

    def make():
        machine = Automaton(shard.value, window)

        def run(texts: pa.Array):
            ranges, items = [], []
            for text in texts.cast(pa.binary()).to_pylist():
                own, names = _summary(machine.scan(words_of(text or b"")))
                places = offsets(text.decode("utf-8"), own) if own else []
                ranges.append([{"a": a, "b": b, **place} for (a, b), place in zip(own, places, strict=True)])
                items.append(names)
            return [pa.array(ranges, _RANGES), pa.array(items, pa.list_(pa.string()))]

        return run

    return make


def _joined(batches):
    """Rows (row, ranges, items) of several shards as (row, n_hit, items, spans)."""
    for batch in batches:
        n_hit, names, spans = [], [], []
        for ranges, items in zip(batch.column("ranges").to_pylist(), batch.column("items").to_pylist(), strict=True):
            first = {r["a"]: r["start"] for r in ranges}
            last = {r["b"]: r["end"] for r in ranges}
            own = merged([(r["a"], r["b"]) for r in ranges])
            n_hit.append(sum(b - a + 1 for a, b in own))
            names.append(sorted({i for i in items if i is not None}) + [None] * (None in items))
            spans.append([{"start": first[a], "end": last[b]} for a, b in own])
        columns = [batch.column("row"), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, _SPANS)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_hit", "items", "spans"])


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep=None,
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``df``'s columns ``keep``, then n_words, n_hit, items (sorted as strings) and spans.

    A word inside any occurrence of any window counts once in ``n_hit``. Null and word-less
    texts have no words and no hits. Items without words have no windows; those without id are one
    null at the end of items, as in the SQL. An empty benchmark hits nothing, and an empty table
    gives no rows. Repeated items and rows are kept as they are. Texts are taken whole; other
    columns may have any names.

    Items of up to ``shard_bytes`` are broadcast as one automaton's patterns, some 110 bytes of
    memory for each of theirs, and ``df`` is read once. More items are cut into shards (a longer
    item into runs of words that overlap): ``df`` is then stored once and each shard takes a pass
    over it, with one automaton a task and its broadcast gone after it; rows with hits are stored
    and meet their documents by row number.
    """
    keep = list(df.columns if keep is None else keep)
    context = df.sparkSession.sparkContext
    shards = _shards(benchmark, item_col, item_text_col, window, shard_bytes)
    first, second = next(shards), next(shards, None)
    if second is None:
        return annotate(df, text_col, _scanner(context.broadcast(first), window), FIELDS, keep=keep)
    kept = [f"k{i}" for i in range(len(keep))]
    columns = [F.col(quoted(c)).alias(k) for c, k in zip(keep, kept, strict=True)]
    stored = cut(df.select(*columns, F.col(quoted(text_col)).cast("string").alias("t"), F.monotonically_increasing_id().alias("row")))
    ranges = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "start", "end")])
    fields = [("ranges", T.ArrayType(ranges)), ("items", T.ArrayType(T.StringType()))]
    parts = []
    for shard in itertools.chain((first, second), shards):
        own = context.broadcast(shard)
        found = annotate(stored, "t", _ranges_of(own, window), fields, keep=["row"])
        parts.append(written(found.filter("size(ranges) > 0"), "hits"))
        own.destroy()
    hits = reduce(DataFrame.unionAll, parts).groupBy("row").agg(*[F.flatten(F.collect_list(n)).alias(n) for n, _ in fields])
    hits = cut(hits.mapInArrow(_joined, T.StructType([T.StructField("row", T.LongType()), *[T.StructField(n, kind) for n, kind in FIELDS[1:]]])))
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits

    def count():
        return lambda texts: [pa.array([len(words_of(t or b"")) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())]

    rows = annotate(stored, "t", count, FIELDS[:1], keep=[*kept, "row"]).join(hits, "row", "left")
    none = [F.coalesce(F.col(n), F.lit(0) if n == "n_hit" else F.array().cast(kind)).alias(n) for n, kind in FIELDS[1:]]
    return rows.select(*kept, "n_words", *none).toDF(*keep, *[n for n, _ in FIELDS])


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text holds any benchmark window; all columns are kept.

    Null, empty and repeated texts, empty tables and clashing names are as in ``contamination``.
    """
    columns = df.columns
    found = contamination(df, benchmark, text_col).toDF(*[f"c{i}" for i in range(len(columns))], *[f"_{n}" for n, _ in FIELDS])
    return found.filter("_n_hit = 0").select(*[f"c{i}" for i in range(len(columns))]).toDF(*columns)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words are numbered, every window of 10 (or a shorter item whole) is joined on its text.
ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM pats),
wins AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, wins.k, item_id FROM wins JOIN pats USING (k, p)),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
