import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import graph, simhash
from graphloom.llm.bktree import BKTree

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=4):
    prints = [slow_fingerprint(t) for _, t in rows]
    names = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = names[i], names[j]
                names = [b if n == a else n for n in names]
    best = {}
    for (doc, _), n in zip(rows, names):
        if doc is not None:
            best[n] = min(doc, best.get(n, doc))
    return [(doc, f"{p:016x}", best.get(n)) for (doc, _), p, n in zip(rows, prints, names)]


def digest(df):
    found = simhash.near_duplicates(df)
    return [tuple(r) for r in found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a B c", "a b c d", "é Ü ß x y z", "a\x0bb\x0cc d e f g", "A B c d e", "x " * 500])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text.encode()), "big") == slow_fingerprint(text)


def clusters(seed, n, centres):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize(("n", "centres"), [(0, 1), (1, 1), (2, 1), (300, 300), (400, 3), (402, 3), (500, 40)])
def test_bktree_against_all_pairs(n, centres):
    values = clusters(n + 4, n, centres) if n else np.empty(0, np.uint64)
    tree = BKTree(values)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4 if n else np.zeros((0, 0), bool)
    for i in range(min(len(values), 30)):
        assert tree.search(int(values[i]), 4) == np.flatnonzero(near[i]).tolist()
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near], dtype=label.dtype) if n else label
        if (new == label).all():
            break
        label = new
    assert tree.components(4).tolist() == label.tolist()
    assert n < 300 or (tree.followed > 0 and tree.visits > n)
    if n > 1:  # the links of two sets of queries together are those of all
        parts = np.array_split(np.random.default_rng(n).permutation(len(values)), 2)
        edges = np.array([(i, j) for part in parts for i, j in enumerate(BKTree(values).components(4, part))])
        merged = np.arange(len(values))
        for _ in range(64):
            low = np.minimum(merged[edges[:, 0]], merged[edges[:, 1]])
            np.minimum.at(merged, edges[:, 0], low)
            np.minimum.at(merged, edges[:, 1], low)
        assert merged.tolist() == label.tolist()


def test_every_node_is_one_value_under_its_distance():
    tree, seen = BKTree(clusters(5, 400, 20)), []
    stack = [tree.root]
    while stack:
        node = stack.pop()
        seen.append(int(node.rows[0]))
        for d, child in node.children.items():
            assert (np.bitwise_count(tree.values[child.rows] ^ tree.values[node.rows[0]]) == d).all()
            stack.append(child)
    assert sorted(seen) == list(range(len(tree.values)))


@pytest.mark.parametrize(("blocks", "split"), [(5, 1 << 16), (5, 7), (6, 100), (7, 1 << 16), (None, 1 << 16)])
def test_links_are_whole_for_any_blocks(spark, blocks, split):
    values = clusters(9, 500, 12).view(np.int64)
    prints = spark.createDataFrame([(int(v),) for v in values], "fp long")
    found = graph.connected_components(simhash.links(prints, 4, blocks, split))
    got = {r.node: r.root for r in found.collect()}
    want = BKTree(values.view(np.uint64)).components(4)
    for i, v in enumerate(values.tolist()):
        mates = values[want == want[i]]
        assert got.get(v, v) == int(mates.min())


def test_near_duplicates_with_odd_rows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    long = [rng.choice(words) for _ in range(400)]
    near = long[:]
    near[7] = "changed"
    rows = [(5, " ".join(long)), (3, " ".join(near)), (9, " ".join(long).upper()), (None, " ".join(long)), (1, "alone here now"), (1, "alone here now")]
    rows += [(20, None), (21, ""), (22, "  "), (None, "nobody knows this text"), (30, "x " * 20000)]
    rows += [(40 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(30)]
    got = digest(spark.createDataFrame(rows, SCHEMA))
    assert sorted(got, key=key) == sorted(slow_components(rows), key=key)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert digest(empty) == [] and simhash.keep_one(empty).count() == 0


def test_keep_one(spark):
    text = "the same words again and again in one line of text"
    rows = [(4, text, 1), (2, text, 2), (2, text, 3), (8, "quite another text with other words in it", 4), (None, text, 5), (None, "lost one", 6), (None, "lost two", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumn("k1", F.lit("x"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((key((r.doc_id, r.text)) for r in kept.collect())) == sorted(key((d, t)) for d, t in [(2, text), (8, rows[3][1]), (None, "lost one"), (None, "lost two")])
    one = kept.filter("doc_id = 2").first()
    assert one.fp in (2, 3)


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.connected_components(edges).collect()
    assert len(got) == 61 and {r.root for r in got} == {0}


def test_query_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, simhash.op9_simhash(spark, "/root/testdata/sf0.001").collect())) == sorted(slow_components(rows))


def test_keep_one_tells_no_id_from_an_empty_one(spark):
    rows = [(None, "SAME text of a few more words"), ("", "same text of a few more words"), ("b", "same text of a few more words")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [tuple(r) for r in kept] == [rows[1]]


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_keep_one_with_and_without_broadcast(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", rows)
    docs = [(i, f"text number {i // 3} with its very own words {i // 3}") for i in range(60)] + [(7, None), (5, "")]
    kept = simhash.keep_one(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(i, docs[i][1]) for i in range(0, 60, 3)] + [(5, "")])


def test_columns_with_the_names_used_inside(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, 6, 7), (2, "A b c d e", 8, 9, 10)], "row long, fp string, root int, c0 int, component_id int")
    assert [tuple(r) for r in simhash.keep_one(df, "row", "fp").collect()] == [(1, "a b c d e", 5, 6, 7)]
    assert sorted(r[0] for r in simhash.near_duplicates(df, "row", "fp").collect()) == [1, 2]
