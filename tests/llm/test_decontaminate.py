import hashlib
import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            v = words(it)
            k = min(10, len(v))
            wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


LONG = " ".join(f"word{i}" for i in range(25))
ITEMS = [(1, LONG), (2, "Short item"), (3, None), (4, "..."), (10, "Ünïcode é ñ 日本 text here in ten words of it now"), (2, "Short item"), (11, "short")]
DOCS = [
    (1, None), (2, ""), (3, "!!! ---"), (4, LONG), (5, "x " + LONG.upper().replace(" ", ", ") + " y"),
    (6, " ".join(LONG.split()[3:13])), (7, " ".join(LONG.split()[3:12])), (8, "a short  ITEM; short\nitem"), (8, "a short  ITEM; short\nitem"),
    (9, "shorty item"), (10, "ünïcode é ñ 日本 text here in ten words of it now"), (None, "short item"), (12, ("pad " * 30000) + LONG),
    (13, LONG + " " + LONG),
]


def run(spark, docs, items, **options):
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = d.contamination(df, b, keep=["doc_id"], **options)
    return [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), d.items_digest(r["items"]), r.n_hit > 0) for r in found.collect()]


def test_against_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == slow(DOCS, ITEMS)


def test_shards_change_nothing(spark):
    assert run(spark, DOCS, ITEMS, shard_bytes=20) == slow(DOCS, ITEMS)


def test_shards_with_a_shuffled_meeting(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    items = [*ITEMS, (None, "clean short item"), (12, " ".join(LONG.split()[5:]))]
    docs = [(i, t) for i, (_, t) in enumerate(DOCS)]
    got = run(spark, docs, items, shard_bytes=60)
    assert sorted(r[:3] + r[5:] for r in got) == [r[:3] + r[5:] for r in slow(docs, items)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, d.contamination(df, bench, shard_bytes=n).collect())) for n in (1 << 20, 60))
    assert one == many


def test_pieces_hold_the_windows_of_their_text():
    for n in (0, 1, 9, 10, 11, 12, 25, 57):
        text = " ".join(f"w{i}" for i in range(n)).encode()
        whole = {tuple(text.split()[i : i + 10]) for i in range(n - 9)}
        for limit in (1, 20, 33, 90, 10**6):
            parts = [p.split() for p in d._pieces(text, 10, limit)]
            assert {tuple(p[i : i + 10]) for p in parts for i in range(len(p) - 9)} == whole
            assert n < 10 or all(len(p) >= 10 for p in parts)


def test_memory_of_an_automaton():
    random.seed(3)
    text = " ".join(random.choice(["alpha", "beta", "gamma", "epsilon"]) + str(random.randrange(9999)) for _ in range(50_000)).encode()
    assert d.Automaton([(1, text)]).machine.get_stats()["total_size"] < 130 * len(text)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert [r[1:4] for r in run(spark, DOCS[:5], [])] == [(len(words(t)), 0, 0) for _, t in DOCS[:5]]


def test_spans_are_offsets_of_the_original(spark):
    df = spark.createDataFrame([(1, "é, see: SHORT -- item! and")], "doc_id long, text string")
    b = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    span = d.contamination(df, b).first()["spans"][0]
    assert df.first().text[span["start"] : span["end"]] == "SHORT -- item"


def test_drop_keeps_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "short item", 5, "a"), (2, "clean", 6, "b")], "doc_id long, text string, n_hit int, spans string")
    kept = d.drop_contaminated(df, spark.createDataFrame(ITEMS[:2], "item_id long, text string"))
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 6, "b")]


def test_items_without_id_count_as_in_sql(spark):
    items = [(None, "Short item"), (None, LONG), (7, LONG)]
    docs = [(1, "a short item"), (2, LONG), (3, "clean text")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    want = con.sql(d.ORACLE_SQL).fetchall()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = d.contamination(df, bench, keep=["doc_id"])
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), None, r.n_hit > 0) for r in found.collect()]
    assert [r[1:4] for r in got] == [(3, 2, 1), (25, 25, 2), (2, 0, 0)]
    digest = found.select("doc_id", F.sha2(F.array_join("items", ","), 256)).collect()
    assert sorted((r[0], *g[1:4], r[1], g[5]) for r, g in zip(digest, got)) == sorted(want)
    assert [r.doc_id for r in d.drop_contaminated(df, bench).collect()] == [3]
