import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import decontaminate, quality, simhash
from graphloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = (before, docs)
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = seen["quality"]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = before.collect()
    score = model.score([quality.Featurizer()((r.text or "").encode()) for r in rows])
    assert ids(after) == {r.doc_id for r, s in zip(rows, score) if s >= quality.THRESHOLD}

    before, after = seen["dedup"]
    groups = simhash.near_duplicates(before)
    assert ids(after) == {r.component_id for r in groups.select("component_id").distinct().collect()}

    before, after = seen["decontaminate"]
    found = decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == ids(found.filter("n_hit = 0"))

    before, after = seen["personal_data"]
    assert ids(after) == ids(before)
    assert not any(re.search(r"[A-Za-z0-9]@[a-z0-9]+\.[a-z]", r.text) for r in after.collect())

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids(packed) == ids(docs) and packed.agg(F.max("length")).first()[0] <= 1024


def test_pipeline_query(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    assert "pipeline" not in entry.oracle_sql()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["s", "n_hit", "fp", "base", "piece", "row", "t", "k0"]


def folder(spark, path, docs, items, labels):
    docs = spark.createDataFrame(docs, DOCS).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs.columns


def test_pipeline_over_empty_tables(spark, tmp_path):
    folder(spark, tmp_path, [], [], [])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() == 0 and {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(packed.columns)


def test_pipeline_over_odd_rows(spark, tmp_path):
    item = "which of these ten words in a row are part of the test"
    rows = [
        (1, "a plain text of its own about rivers and hills", "en"), (1, "a plain text of its own about rivers and hills", "en"), (None, None, None), (3, "", ""),
        (None, "this row has no id and yet a text that nobody else has", None), (5, f"we ask {item.upper()} today", "en"), (6, "mail ann@corp.example now please", "en"),
        (7, "  A plain TEXT of its own about rivers and hills ", "en"), (8, "long words " * 30000 + "the end", "en"), (9, " " * 300_000 + "wide", None),
    ]
    docs = [(i, t, lang, None, len(t) if t else None) for i, t, lang in rows]
    columns = folder(spark, tmp_path, docs, [(None, None), (2, item), (2, item), (4, "")], [(1, 1, 0), (99, None, None)])
    stages, kept = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in list(stages)[:-1]:
        kept = corpus_pipeline.written(stages[name](spark, kept, str(tmp_path)), name)
        assert kept.columns == columns
    # One class of labels makes a constant score, which keeps all; blank texts are one group.
    got = {(r.doc_id, r.text) for r in kept.collect()}
    want = {(r[0], r[1]) for r in docs if r[0] not in (5, 6, 7, 9)} - {(None, None)} | {(6, "mail [EMAIL] now please"), (9, docs[-1][1])}
    assert got == want and kept.count() == len(want)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in want} and all(0 < r.length <= 1024 for r in packed)
    longest = sorted((r.piece, r.start, r.length) for r in packed if r.doc_id == 8)
    assert [p for p, _, _ in longest] == list(range(len(longest))) and sum(n for _, _, n in longest) > 60_000
    assert all(a + n == b for (_, a, n), (_, b, _) in zip(longest, longest[1:]))


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "decontaminate", "personal_data", "packing"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    one, two = (df[columns].sort_values("doc_id").reset_index(drop=True) for df in (got, want))
    pd.testing.assert_frame_equal(one, two)
