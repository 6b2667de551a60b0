"""The corpus pipeline: classify, deduplicate, decontaminate, sanitise, pack.

Every stage takes whole texts of any length and any number of columns, whatever their names; a null
text counts as empty, ids may be null or repeat, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.packing import pack
from graphloom.llm.pii import sanitise
from graphloom.llm.quality import keep_good
from graphloom.llm.simhash import keep_one
from graphloom.llm.storage import drop_written, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores under its threshold go.

    A score equal to the threshold stays, and equal texts have equal scores. Without labels of both
    classes the score is a constant: the share of good labels, 0.5 where there are none.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays.

    A document without id stays only where its group has no id. Of several with that id the least
    fingerprint stays, then the least hash of the text, then the first row. Null and blank texts
    are one group.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Items without words match nothing, those without id match like any other; an empty benchmark
    keeps every document.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced, and what reveals it; every document stays.

    A term whose disclosure equals a threshold is over it. Null and empty texts stay as they are.
    """
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its token ids and its place in a sequence.

    Null and empty texts are the end token alone; rows that repeat are packed each.
    """
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("dedup", dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifier and the tokenizer are not expressible in SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir), name)
        if i:
            drop_written(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
