"""The classifier, the language model and the secret tagger: right arithmetic, held-out accuracy."""

import itertools
import math
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.llm import langid, quality, secret_scan

SF = "/root/testdata/sf0.01"


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=24).astype(np.float32), rng.normal(size=(24, 3)).astype(np.float32), np.zeros(16), np.ones(16), 8)
    rows = [(np.array([1, 4, 7], np.int32), np.array([0.5, 0.25, 2.0], np.float32), rng.normal(size=16).tolist()) for _ in range(5)]
    index, value, starts = model.inputs(rows)
    got = model.raw(index, value, starts)
    for r, (a, b) in enumerate(zip(starts, [*starts[1:], len(index)])):
        x = np.zeros(24)
        np.add.at(x, index[a:b], value[a:b])
        pairs = sum((model.factor[i] @ model.factor[j]) * x[i] * x[j] for i, j in itertools.combinations(range(24), 2))
        assert math.isclose(got[r], 0.3 + model.weight @ x + pairs, rel_tol=1e-4, abs_tol=1e-4)


def test_quality_on_held_out_rows(spark):
    found = quality.op2_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert found.count() == pq.read_metadata(f"{SF}/documents.parquet").num_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.collect())


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 8), (None, "words " * 50000, 9), (2, "", 8)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.scores(docs, model, keep=["doc_id", "score"], name="s").collect()
    assert len(got) == 4 and all(0 <= r.s <= 1 for r in got) and [r.score for r in got] == [7, 8, 9, 8]
    empty = docs.limit(0)
    assert quality.scores(empty, model).count() == 0 and quality.keep_good(empty, labels).columns == docs.columns
    assert quality.train(empty, labels.limit(0)).score([]).size == 0


def dense(model, data):
    """Inputs of a text by loops: log frequencies of buckets scaled to length 1, then scaled statistics."""
    words = data.split()
    sums = Counter(zlib.crc32(w.lower().strip(quality._EDGES)) % model.buckets for w in words)
    x = np.zeros(model.buckets + len(quality.STATS))
    for b, n in sums.items():
        x[b] = math.log1p(n)
    x /= max(math.sqrt((x * x).sum()), 1e-9)
    stats = np.array(quality.structure(data, words, Counter(words)))
    x[model.buckets :] = np.clip((stats - model.mean) / model.scale, -4, 4) / math.sqrt(len(stats))
    return x


def by_pairs(bias, weight, factor, x):
    used = np.flatnonzero(x)
    pairs = (factor[used] @ factor[used].T) * np.outer(x[used], x[used])
    return bias + weight @ x + np.triu(pairs, 1).sum()


def test_quality_query_against_every_pair(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.op2_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = by_pairs(model.bias, model.weight.astype(float), model.factor.astype(float), dense(model, (r.text or "").encode()))
        want = 1 / (1 + math.exp(-raw))
        assert math.isclose(got[r.doc_id].score, want, rel_tol=1e-3, abs_tol=1e-5)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_quality_step_against_numeric_gradient():
    texts, labels, buckets, factors = [b"Good words here.", b"bad bad!! | | bad", b"good, words again\nhere", b"bad | x"], np.array([1, 0, 1, 0]), 16, 3
    featurize = quality.Featurizer(buckets)
    rows = [featurize(t) for t in texts]
    model = quality.fit(rows, labels, buckets, factors, epochs=1)
    n = buckets + len(quality.STATS)
    start = np.concatenate(([math.log(3 / 3)], np.zeros(n), np.random.default_rng(7).normal(0, 0.05, (n, factors)).ravel()))
    x = np.array([dense(model, t) for t in texts])

    def loss(p):
        raw = np.array([by_pairs(p[0], p[1 : n + 1], p[n + 1 :].reshape(n, factors), own) for own in x])
        return np.mean(np.log1p(np.exp(-np.where(labels == 1, raw, -raw))))

    seen = np.zeros(n)
    for i, _, _ in rows:
        seen[i] = 1
    seen[buckets:] = 1
    decay = 2e-5 * start * np.concatenate(([0], seen, np.repeat(seen, factors)))
    step = np.eye(len(start)) * 1e-5
    g = np.array([(loss(start + h) - loss(start - h)) / 2e-5 for h in step]) + decay
    want = start - 0.1 * g / np.sqrt(g * g + 1e-6)
    got = np.concatenate(([model.bias], model.weight, model.factor.ravel()))
    assert np.allclose(got, want, atol=2e-4)


def test_quality_learns_from_a_bounded_sample_where_ids_repeat(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 7, f"text {i} of id {i % 7}", i) for i in range(700)], "doc_id long, text string, h int").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(quality, "fit", lambda rows, y: taken.append((len(rows), y, [r[2] for r in rows])))
    quality.train(docs, labels, max_train=30)
    quality.train(docs.repartition(3), labels, max_train=30)
    assert taken[0] == taken[1] and taken[0][0] == len(taken[0][1]) == 30


def test_quality_ignores_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    one = [r.score for r in quality.scores(docs, model, keep=[]).collect()]
    two = [r.score for r in quality.scores(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.lit(0)), model, keep=[]).collect()]
    assert one == two


def test_naive_bayes_arithmetic():
    texts = {"aa": ["abab", "ab b"], "bb": ["zz yz", "zy"]}
    counts = {n: sum(np.bincount(langid.grams(langid.folded(t)[0], 64), minlength=64) for t in ts) for n, ts in texts.items()}
    model = langid.fit(counts, {n: len(ts) for n, ts in texts.items()}, 64)
    names, scores = model.predict(["abz"])
    total = {}
    for n in texts:
        p = (counts[n] + langid.SMOOTHING) / (counts[n] + langid.SMOOTHING).sum()
        total[n] = math.log(0.5) + sum(math.log(p[g]) for g in langid.grams(langid.folded("abz")[0], 64))
    want = math.exp(total["aa"]) / sum(map(math.exp, total.values()))
    assert names == ["aa"] and math.isclose(scores[0], want, rel_tol=1e-4)


def test_folding():
    assert langid.folded("Ab, c1d")[0].tolist() == [0, 97, 98, 0, 99, 0, 100, 0]
    assert langid.folded("!!x")[0].tolist() == [0, 120, 0]
    assert langid.folded("12 !")[1] is False and langid.folded("")[1] is False
    assert len(langid.grams(langid.folded("ab")[0])) == 2 + 3 + 2  # a b; _a ab b_; _ab ab_


def test_blocks_change_nothing(monkeypatch):
    texts = ["", "..", "Ab, c1d", "one two  three", "x", "der Hund, 12 die Katze!", "日本 é", "a1" * 9, "1" * 9 + "ab" + "-" * 9]
    whole = [langid.folded(t) for t in texts]
    model = langid.fit({"aa": np.bincount(langid.grams(whole[3][0], 64), minlength=64), "bb": np.bincount(langid.grams(whole[5][0], 64), minlength=64)}, {"aa": 1, "bb": 2}, 64)
    names, scores = model.predict(texts)
    for size in (1, 2, 3, 5, 8):
        monkeypatch.setattr(langid, "BLOCK", size)
        for t, (points, letter) in zip(texts, whole):
            assert langid.folded(t)[1] == letter and langid.folded(t)[0].tolist() == points.tolist()
            parts = [g for part in langid.gram_blocks(points, 64) for g in part.tolist()]
            assert sorted(parts) == sorted(langid.grams(points, 64).tolist())
        got = model.predict(texts)
        assert got[0] == names and np.allclose(got[1], scores, rtol=1e-9)


def test_language_ties():
    counts = np.bincount(langid.grams(langid.folded("ab")[0], 64), minlength=64)
    for order in (["xx", "aa", "mm"], ["mm", "xx", "aa"]):
        names, scores = langid.fit({n: counts for n in order}, {n: 1 for n in order}, 64).predict(["ab", "q"])
        assert names == ["aa", "aa"] and np.allclose(scores, 1 / 3)


def test_language_long_text_is_scored_in_bounded_memory():
    counts = np.bincount(langid.grams(langid.folded("the cat")[0]), minlength=langid.BUCKETS)
    model = langid.fit({n: counts for n in "abcdefgh"}, {n: 1 for n in "abcdefgh"})
    text = "the cat sat " * 400_000
    langid.letters()
    tracemalloc.start()
    model.predict([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)


def slow_grams(text, buckets):
    """The n-grams' buckets by loops over strings."""
    points = [0]
    for c in text.lower():
        p = ord(c) if unicodedata.category(c)[0] == "L" else 0
        points += [p] if p or points[-1] else []
    points += [0] if points[-1] else []
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            own = points[i : i + n]
            if own == [0] or (n == 3 and not own[1]) or len(points) == 1:
                continue
            h = n
            for p in own:
                h = ((h ^ (p * 2654435761 & 0xFFFFFFFF)) * 16777619) & 0xFFFFFFFF
                h ^= h >> 15
            yield h % buckets


def test_language_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    buckets, counts, rows = langid.BUCKETS, {}, {}
    grams = [Counter(slow_grams(r.text or "", buckets)) for r in docs]
    for r, own in zip(docs, grams):
        if own and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(own)
            rows[r.lang] = rows.get(r.lang, 0) + 1
    logs = {n: (math.log(rows[n] / sum(rows.values())), math.log(sum(c.values()) + langid.SMOOTHING * buckets)) for n, c in counts.items()}
    want = {}
    for r, own in zip(docs, grams):
        total = {n: prior + sum(k * (math.log(counts[n][g] + langid.SMOOTHING) - size) for g, k in own.items()) for n, (prior, size) in logs.items()}
        best = max(sorted(total), key=total.get)
        want[r.doc_id] = (best, 1 / sum(math.exp(t - total[best]) for t in total.values())) if own else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op6_langid(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and math.isclose(got[d][1], want[d][1], rel_tol=1e-3) for d in want)


def test_languages_on_held_out_rows(spark):
    found = langid.op6_langid(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.collect())


def test_language_odd_tables(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(8)] + [(20 + i, "der hund und die katze", "de", 1) for i in range(8)]
    rows += [(50, None, "en", 1), (51, "", None, 1), (52, "123 !?", "de", 1), (None, "the dog", None, 1), (53, "der " * 40000, None, 1), (53, "日本語", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(docs)
    got = [(r.doc_id, r.lang_pred, r.score_) for r in langid.identify(docs, model, keep=["doc_id"]).withColumnRenamed("score", "score_").collect()]
    by_id = {d: (n, s) for d, n, s in got if d in (50, 51, 52, None)}
    assert by_id[50] == by_id[51] == by_id[52] == ("und", 0.0) and by_id[None][0] == "en"
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def slow_base(text):
    import re

    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@pytest.mark.parametrize(
    "text",
    ["", "token = abc", "token=abcdef", 'My "Password": \'hunter22\'', "toKen = x token = yyyyyyy", "APIKEY:aaaaaa api_key=bbbbbb", "ſecret=abcdef toKen=abcdef", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 12, "a" * 23, "f" * 24, "xx" + "0" * 30 + "g" + "1" * 24, "secret token=abcdef passwd = 'ééé'", "token\n=abcdef"],
)
def test_base_secrets(text):
    assert secret_scan.base_spans(text) == slow_base(text)


def test_viterbi_against_every_path():
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(3, 3))
    moves[0, 2] = secret_scan.NEVER
    lengths = [1, 4, 6, 2, 6]
    scores = rng.normal(size=(sum(lengths), 3)) * 2
    stops = np.cumsum(lengths)
    starts = stops - lengths
    tags = secret_scan.viterbi(scores, moves, starts, stops)
    for a, b in zip(starts, stops):
        value = lambda p, a=a: sum(scores[a + i, t] for i, t in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:])) + (secret_scan.NEVER if p[0] == 2 else 0)
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert tags[a:b].tolist() == list(best)


def test_cold_lines_are_outside():
    """Lines that the tagger leaves out would be tagged outside by a full search too."""
    rng = np.random.default_rng(5)
    field = secret_scan.Field(rng.normal(size=(len(secret_scan.OFFSETS), len(secret_scan.FEATURES), 3)), rng.normal(size=(3, 3)), np.zeros((4, 3)))
    field.weights[0, :, 0] += 0.6
    texts = ["plain words here\ntoken = abcDEF123456\n\nmore", "x = 1 \"y\"", "", "one"] * 5
    pruned, whole = secret_scan.Tagger(field), secret_scan.Tagger(field)
    whole.cold = -1e9
    assert list(pruned.tag(texts)) == list(whole.tag(texts))


def test_field_learns_and_keeps_base(spark, field):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tagger = secret_scan.Tagger(field)
    texts = [r.text or "" for r in docs.collect()]
    found = secret_scan.find(tagger, texts)
    total = hit = clean = 0
    for text, spans in zip(texts, found):
        base = slow_base(text)
        assert [s for s in spans if s[1] < 3] == base
        clean += not base and bool(spans)
        tagged = dict(tagger.tag([text])).get(0, [])
        for a, _, b in base:
            total += 1
            hit += any(x < b and a < y for x, y in tagged)
    assert hit / total > 0.9 and clean / len(texts) < 0.005
    new = 'the of pwd: "Zx81kkq0fA77bb1290aa" and'
    assert any(k == 3 and new[a:b] == "Zx81kkq0fA77bb1290aa" for a, k, b in secret_scan.find(tagger, [new])[0])


@pytest.fixture(scope="module")
def field(spark):
    return secret_scan.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


#: Forms that no base pattern finds and that training does not make up: other names, signs, quotes and values.
PLANTED = [
    ("webhook_pwd -> {}", "mK93xQ77vbT2pLz0"), ("the admin credential was {} until May", "Rw82hjKLp019zmQx"), ("smtp auth [{}]", "9f8E7d6C5b4A3f2E1d0C"),
    ("deploy key <{}>", "Zq0Xw19Lm28Kp37Vn46Bc"), ("Authorization: Bearer {}", "eyJhbGciOiJIUzI1NiJ9xYz12Qw"), ("export GH_AUTH={}", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"),
    ("login pwd ~ {} ~", "Sommer2019Regen77"), ("aws id ASIA then {}", "ASIAQ4X7Z2LMNB8P0KJD"), ("stripe: sk_live_{}", "4eC39HqLyjWDarjtT1zdp7dc"), ("|pwd|{}|", "tR7uLq92XzPbWe4"),
]


def test_planted_forms_and_harmless_ones(spark, field):
    """Recall over planted forms in the corpus' own prose, and false findings in it and in look-alikes."""
    tagger = secret_scan.Tagger(field)
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and not slow_base(r.text)]
    hit = total = 0
    for i, (form, value) in enumerate(PLANTED):
        for line in [" ".join(p.split()[:12]) for p in prose[i * 10 : i * 10 + 10]]:
            text = f"{line} {form.format(value)} {line}"
            hit += any(k == 3 and a < text.index(value) + len(value) // 2 < b for a, k, b in secret_scan.find(tagger, [text])[0])
            total += 1
    plain = ["version = 10.2.31", "page: 1234567", "name = 'Elizabeth Montgomery'", "date: 2019-07-28", "the keyboard is very old", "call +1 743 555 3824 now", "see https://www.example.org/path/of/page"]
    wrong = [t for t in plain if secret_scan.find(tagger, [f"some words {t} and more"])[0]]
    false = sum(bool(s) for s in secret_scan.find(tagger, prose))
    print(f"planted forms found {hit} of {total}; look-alikes {len(wrong)} of {len(plain)}; prose {false} of {len(prose)}")
    assert hit / total >= 0.7 and len(wrong) <= 1 and false / len(prose) < 0.02


def test_forward_backward_against_every_path():
    rng = np.random.default_rng(3)
    moves, lengths = rng.normal(size=(3, 3)) * 2, [1, 5, 3]
    moves[0, 2] = secret_scan.NEVER
    scores = rng.normal(size=(5, 3, 3)) * 4
    mask = np.arange(5)[:, None] < np.array(lengths)
    found, expected, total = secret_scan.marginals(scores, mask, moves)
    want = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        value = lambda p, c=c: sum(scores[i, c, t] for i, t in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:])) + (secret_scan.NEVER if p[0] == 2 else 0)
        weights = {p: np.exp(value(p)) for p in itertools.product(range(3), repeat=n)}
        z = sum(weights.values())
        assert total[c] == pytest.approx(np.log(z))
        for i in range(n):
            assert found[i, c] == pytest.approx([sum(w for p, w in weights.items() if p[i] == t) / z for t in range(3)])
        assert (found[n:, c] == 0).all()
        for p, w in weights.items():
            np.add.at(want, (list(p[:-1]), list(p[1:])), w / z)
    assert expected == pytest.approx(want)


def test_a_very_long_line_is_several_chains(field):
    text = "word=1 " * 200_000 + 'pwd: "Zx81kkq0fA77bb1290aa" ' + "end " * 10
    spans = secret_scan.find(secret_scan.Tagger(field), [text])[0]
    assert any("Zx81kkq0fA77bb1290aa" in text[a:b] for a, _, b in spans)


def test_secrets_odd_tables(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "token = abcdef0123", 1), (3, "w " * 30000 + "\n" + "f" * 30, 1), (3, "token = abcdef0123", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int")
    field = secret_scan.train(docs)
    out = secret_scan.secrets(docs, field, keep=["doc_id"]).collect()
    assert [len([s for s in r["found"] if s["kind"] < 3]) for r in out] == [0, 0, 1, 1, 1]
    none = secret_scan.train(docs.limit(0))
    assert secret_scan.secrets(docs.limit(0), none).count() == 0
    again = secret_scan.secrets(docs, none, keep=["doc_id"]).collect()
    assert [s["kind"] for r in again for s in r["found"]] == [0, 2, 0]


def test_field_learns_where_many_texts_only_name_secrets(spark):
    prose = [(f"the token of row {i} is no secret, and a password is a word",) for i in range(400)]
    real = [(f"row {i}\npassword = 'hunter{i * 7919}x'\nend",) for i in range(40)]
    field = secret_scan.train(spark.createDataFrame(prose + real, "text string"), max_with=3, max_without=20)  # the least three hashes are prose
    assert field.files[:, 0].max() < 10  # one that tags nothing has -NEVER
    hit = spark.createDataFrame([(t,) for t, in prose[:5] + real[:5]], "t string").select(F.col("t").rlike(secret_scan.HIT)).collect()
    assert [r[0] for r in hit] == [False] * 5 + [True] * 5


def test_parts_of_field_spans_beyond_base_spans_stay():
    class Fixed:
        def tag(self, texts):
            yield 0, [(11, len(texts[0]))]

    text = "password = hunter2!Extra#9999"
    assert secret_scan.find(Fixed(), [text]) == [[(0, 0, 18), (18, 3, len(text))]]
    assert secret_scan.find(Fixed(), [text[:22]]) == [[(0, 0, 18)]]
