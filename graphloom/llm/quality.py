"""Quality classifier: a factorisation machine over hashed words, structure and length.

    y = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The last term is every pairwise interaction, at a cost linear in a text's features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import annotate, quoted

#: Hash buckets for words, latent factors, and the most labelled rows that a fit takes.
BUCKETS, FACTORS, MAX_TRAIN = 8192, 8, 6000
THRESHOLD, FOLDS = 0.3, 5

STATS = (
    "log_chars", "log_words", "chars_a_word", "upper", "digits", "marks", "spaces", "other_bytes",
    "distinct_words", "repeats_next", "bars", "bangs", "mark_ends", "distinct_lines", "words_a_line", "top_word",
)

_LETTERS, _UPPER, _DIGIT, _SPACE, _MARK, _HIGH = range(6)
_CLASS = np.array(
    [
        _HIGH if c >= 128 else _UPPER if 65 <= c <= 90 else _LETTERS if 97 <= c <= 122 else _DIGIT if 48 <= c <= 57 else _SPACE if c <= 32 else _MARK
        for c in range(256)
    ],
    dtype=np.uint8,
)
_EDGES = b".,;:!?\"'()[]{}|#$%&*-_"
_MARKS = frozenset(_EDGES)


def structure(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n, k = max(len(data), 1), max(len(words), 1)
    share = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6) / n
    letters = max(share[_LETTERS] + share[_UPPER], 1e-9)
    lines = data.split(b"\n")
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        len(data) / k,
        share[_UPPER] / letters,
        share[_DIGIT],
        share[_MARK],
        share[_SPACE],
        share[_HIGH],
        len(counts) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k,
        counts[b"|"] / k,
        data.count(b"!!") / k,
        sum(w[-1] in _MARKS and w[-2:-1] == w[-1:] for w in counts) / max(len(counts), 1),
        len(set(lines)) / len(lines),
        np.log1p(k / len(lines)),
        max(counts.values(), default=0) / k,
    ]


class Featurizer:
    """Bucket numbers, each once, and values of each text: term frequencies scaled to unit length."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def words(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > 1 << 18:
            self.known.clear()
        known, sums = self.known, {}
        for w, n in counts.items():
            b = known.get(w)
            if b is None:
                b = known[w] = zlib.crc32(w.lower().strip(_EDGES)) % self.buckets
            sums[b] = sums.get(b, 0) + n
        index = np.fromiter(sums, np.int32, len(sums))
        value = np.log1p(np.fromiter(sums.values(), np.float32, len(sums)))
        return index, value / max(float(np.sqrt((value * value).sum())), 1e-9)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
        words = data.split()
        counts = Counter(words)
        return *self.words(counts), structure(data, words, counts)


@dataclass
class Model:
    """``bias``, ``weight`` (n) and ``factor`` (n, k); inputs after ``mean`` and ``scale``."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    buckets: int = BUCKETS

    def inputs(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, value, start of each row) of rows as Featurizer gives them."""
        own = np.arange(self.buckets, self.buckets + len(self.mean), dtype=np.int32)
        index, value, starts, at = [], [], [], 0
        for i, v, stats in rows:
            scaled = np.clip((np.asarray(stats) - self.mean) / self.scale, -4, 4) / np.sqrt(len(self.mean))
            index += [own, i]
            value += [scaled.astype(np.float32), v.astype(np.float32)]
            starts.append(at)
            at += len(own) + len(i)
        return np.concatenate(index), np.concatenate(value), np.array(starts)

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.factor[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weight[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def score(self, rows) -> np.ndarray:
        if not rows:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.inputs(rows)).astype(np.float64), -30, 30)))


def fit(rows, labels, buckets: int = BUCKETS, factors: int = FACTORS, epochs: int = 12, rate: float = 0.1, l2: float = 2e-5, seed: int = 7) -> Model:
    """Log loss by AdaGrad in small batches. Without rows, or with one class, a constant score."""
    labels = np.asarray(labels, dtype=np.float64)
    stats = np.array([r[2] for r in rows]).reshape(len(rows), len(STATS))
    mean = stats.mean(axis=0) if len(rows) else np.zeros(len(STATS))
    scale = np.maximum(stats.std(axis=0), 1e-6) if len(rows) else np.ones(len(STATS))
    n, rng = buckets + len(STATS), np.random.default_rng(seed)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(prior / (1 - prior))), np.zeros(n, np.float32), np.zeros((n, factors), np.float32), mean, scale, buckets)
    if len(set(labels.tolist())) < 2:
        return model
    model.factor[:] = rng.normal(0, 0.05, (n, factors))
    seen_w, seen_v, seen_b = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            own = order[at : at + 64]
            index, value, starts = model.inputs([rows[i] for i in own])
            row = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(index))))
            error = 1 / (1 + np.exp(-np.clip(model.raw(index, value, starts), -30, 30))) - labels[own]
            g = error / len(own)
            used, place = np.unique(index, return_inverse=True)
            vx = model.factor[index] * value[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            each = (g[row] * value)[:, None] * (sums[row] - vx)
            gw = np.bincount(place, weights=g[row] * value, minlength=len(used)) + l2 * model.weight[used]
            gv = np.stack([np.bincount(place, weights=each[:, f], minlength=len(used)) for f in range(factors)], axis=1) + l2 * model.factor[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_b += g.sum() ** 2
            model.weight[used] -= rate * gw / np.sqrt(seen_w[used])
            model.factor[used] -= rate * gv / np.sqrt(seen_v[used])
            model.bias -= rate * g.sum() / np.sqrt(seen_b)
    return model


def held_out(id_col) -> F.Column:
    """crc32 of the id as text leaves 0 by FOLDS; a null id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(True))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` labelled rows that are not held out.

    The sample is that of the least hashes of (id, label), then of the text, the same at every run.
    Features are made where the texts are; the driver gets at most ``max_train`` sparse rows, also
    where ids repeat. Labels other than 0 and 1 and rows without label or id are not learned from;
    a null text is an empty one. Without rows, or with one class, the model is a constant. Other columns
    may have any names.
    """
    rows = labels.select(F.col(quoted(id_col)).alias("k"), F.col(quoted(label_col)).cast("int").alias("y"))
    rows = rows.filter(F.col("y").isin(0, 1) & ~held_out(F.col("k"))).orderBy(F.xxhash64("k", "y"), "k", "y").limit(max_train)
    texts = df.select(F.col(quoted(id_col)).alias("k"), F.col(quoted(text_col)).cast("string").alias("t"))
    chosen = texts.join(F.broadcast(rows), "k").withColumn("h", F.xxhash64("t"))  # max_train rows of two numbers

    def make():
        featurize = Featurizer()

        def run(texts: pa.Array):
            made = [featurize(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
            return [
                pa.array([i for i, _, _ in made], pa.list_(pa.int32())),
                pa.array([v for _, v, _ in made], pa.list_(pa.float32())),
                pa.array([s for _, _, s in made], pa.list_(pa.float64())),
            ]

        return run

    fields = [("i", T.ArrayType(T.IntegerType())), ("v", T.ArrayType(T.FloatType())), ("s", T.ArrayType(T.DoubleType()))]
    found = annotate(chosen, "t", make, fields, keep=["k", "y", "h"])
    found = found.orderBy(F.xxhash64("k", "y"), "k", "y", "h").limit(max_train).toArrow()
    found = found.combine_chunks().sort_by([(c, "ascending") for c in ("k", "y", "h")]) if found.num_rows else found
    got = [found.column(c).to_pylist() for c in ("i", "v", "s")]
    parsed = [(np.array(i, np.int32), np.array(v, np.float32), s) for i, v, s in zip(*got, strict=True)]
    return fit(parsed, found.column("y").to_pylist())


def scores(df: DataFrame, model: Model, text_col: str = "text", keep=None, name: str = "score") -> DataFrame:
    """``df``'s columns ``keep`` and a score from 0 to 1 for each row; null scores as empty text.

    Equal texts score alike, repeated rows stay, and an empty table gives no rows. Texts are taken
    whole; other columns may have any names, also that of the score.
    The model is broadcast: ``(buckets + 16) * (factors + 1)`` numbers whatever the input.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model, featurize = shared.value, Featurizer(shared.value.buckets)

        def run(texts: pa.Array):
            data, out = texts.cast(pa.binary()).to_pylist(), []
            for at in range(0, len(data), 256):
                out.append(model.score([featurize(t or b"") for t in data[at : at + 256]]))
            return [pa.array(np.concatenate(out))]

        return run

    return annotate(df, text_col, make, [(name, T.DoubleType())], keep=keep)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without the rows that score under ``threshold``; all columns are kept.

    A score equal to it stays. Null, empty and repeated texts, empty tables and clashing names are
    as in ``scores``.
    """
    columns = df.columns
    found = scores(df, train(df, labels, id_col, text_col), text_col).toDF(*[f"c{i}" for i in range(len(columns))], "s")
    return found.filter(F.col("s") >= threshold).drop("s").toDF(*columns)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model, keep=["doc_id"]).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
