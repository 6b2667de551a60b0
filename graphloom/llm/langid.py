"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import annotate, quoted

#: Code points that are folded and scored at once.
BLOCK = 1 << 18
#: Hash buckets, n-gram orders, and the most labelled rows that a fit takes.
BUCKETS, ORDERS, MAX_TRAIN = 1 << 15, (1, 2, 3), 20000
FOLDS, FOLD, UNKNOWN = 4, 2, "und"
SMOOTHING = 0.1
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter (or a mark on one), by Unicode's categories."""
    if not _LETTER:
        _LETTER.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def folded(text: str) -> tuple[np.ndarray, bool]:
    """Lower-case code points with each run of others, and each end, as one 0; and if any is a letter."""
    text, table, edge = text.lower(), letters(), np.zeros(1, np.uint32)
    out, last, any_letter = [edge], edge, False
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le"), dtype=np.uint32)
        points = np.where(table[points], points, np.uint32(0))
        before = np.concatenate((last, points[:-1]))
        out.append(points[(points != 0) | (before != 0)])
        last, any_letter = points[-1:], any_letter or bool(points.any())
    if not any_letter:
        return np.zeros(0, np.uint32), False
    return np.concatenate([*out, edge] if last[0] else out), True


def grams(points: np.ndarray, buckets: int = BUCKETS, starts: int | None = None) -> np.ndarray:
    """Bucket of each n-gram of the orders, of those at the first ``starts`` points if that is given.

    An n-gram may span a word's edge but not two words.
    """
    out = [np.empty(0, np.int32)]
    mix = points.astype(np.uint32) * np.uint32(2654435761)
    for n in ORDERS:
        count = len(points) - n + 1 if starts is None else min(len(points) - n + 1, starts)
        if count <= 0:
            break
        h = np.full(count, n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ mix[i : i + count]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        inner = np.ones(count, bool)
        if n == 1:
            inner = points[:count] != 0
        elif n > 2:
            inner = ~(points[1 : 1 + count] == 0)  # the middle is a letter
        out.append((h[inner] % np.uint32(buckets)).astype(np.int32))
    return np.concatenate(out)


def gram_blocks(points: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The n-grams of ``points`` by blocks of BLOCK first points, none lost at a block's edge."""
    for at in range(0, len(points), BLOCK):
        found = grams(points[at : at + BLOCK + max(ORDERS) - 1], buckets, BLOCK)
        if len(found):
            yield found


@dataclass
class Model:
    """``log_prob`` (buckets, languages), ``prior`` and the languages in sorted order."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Best language and its posterior; UNKNOWN and 0 for a text without letters.

        Of languages that score alike the first in sorted order is taken. Rows of the matrix are
        gathered for BLOCK to 3 BLOCK n-grams at a time, so a text's length adds code points only.
        """
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        rows: list[int] = []
        totals: list[np.ndarray] = []
        parts: list[np.ndarray] = []  # n-grams to be summed, and the place in totals that each belongs to
        owner: list[int] = []
        held = 0

        def flush() -> None:
            starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
            for i, own in zip(owner, np.add.reduceat(self.log_prob[np.concatenate(parts)], starts, axis=0, dtype=np.float64), strict=True):
                totals[i] += own
            parts.clear()
            owner.clear()

        for i, text in enumerate(texts):
            points, any_letter = folded(text or "")
            if not any_letter:
                continue
            rows.append(i)
            totals.append(self.prior.copy())
            for part in gram_blocks(points, len(self.log_prob)):
                if held and held + len(part) > BLOCK:
                    flush()
                    held = 0
                parts.append(part)
                owner.append(len(totals) - 1)
                held += len(part)
        if not rows:
            return names, scores
        flush()
        summed = np.stack(totals)
        best = summed.argmax(axis=1)
        posterior = 1 / np.exp(summed - summed.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, p in zip(rows, best, posterior, strict=True):
            names[i], scores[i] = self.languages[b], float(p)
        return names, scores


def fit(counts: dict[str, np.ndarray], rows: dict[str, int], buckets: int = BUCKETS) -> Model:
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    table = np.stack([counts[n] for n in names], axis=1).astype(np.float64) + SMOOTHING
    prior = np.log(np.array([rows[n] for n in names], np.float64) / sum(rows.values()))
    return Model(names, np.log(table / table.sum(axis=0)).astype(np.float32), prior)


def held_out(id_col) -> F.Column:
    """crc32 of the id as text leaves 2 by 4; a null id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == FOLD, F.lit(True))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, buckets: int = BUCKETS) -> Model:
    """Fit on at most ``max_train`` rows with a language that are not held out.

    The sample is that of the least hashes of (id, language), the same at every run; an id that
    repeats with its language is trained on in all its rows. Tasks count n-grams where the texts
    are; counts of all tasks are summed on the executors, so the driver gets at most ``buckets`` + 1
    numbers for each language, whatever the number of tasks, and never texts. Rows without text
    or letters are not learned from; an empty table gives a model without languages. Other
    columns may have any names.
    """
    rows = df.select(F.col(quoted(id_col)).alias("k"), F.col(quoted(lang_col)).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("k")))
    rows = rows.orderBy(F.xxhash64("k", "lang"), "k", "lang").limit(max_train).distinct()
    texts = df.select(F.col(quoted(id_col)).alias("k"), F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).cast("string").alias("t"))
    chosen = texts.join(F.broadcast(rows), ["k", "lang"], "left_semi")  # max_train rows

    def count(batches):
        total: dict[str, np.ndarray] = {}  # the last place counts texts
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist(), strict=True):
                points, any_letter = folded(text or "")
                if any_letter:
                    own = total.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    own[-1] += 1
                    for part in gram_blocks(points, buckets):
                        own[:-1] += np.bincount(part, minlength=buckets)
        for lang, own in total.items():
            used = np.flatnonzero(own)
            columns = [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(own[used])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    summed = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    for lang, bucket, n in zip(*(c.to_pylist() for c in summed.columns), strict=True):
        counts.setdefault(lang, np.zeros(buckets + 1, np.int64))[bucket] = n
    return fit({k: c[:-1] for k, c in counts.items()}, {k: int(c[-1]) for k, c in counts.items()}, buckets)


def identify(df: DataFrame, model: Model, text_col: str = "text", keep=None) -> DataFrame:
    """``df``'s columns ``keep``, then lang_pred and score (the posterior, 0 to 1).

    Null and empty texts and texts without a letter get ``und`` and 0, as does every text of a model
    without languages. Ties go to the first language in sorted order. Repeated rows stay, and
    an empty table gives none. Texts are taken whole; other columns may have any names. The matrix is broadcast: ``buckets`` by the languages learned.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts: pa.Array):
            names, scores = shared.value.predict(texts.to_pylist())
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return run

    return annotate(df, text_col, make, [("lang_pred", T.StringType()), ("score", T.DoubleType())], keep=keep, chunk_bytes=1 << 20)


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
