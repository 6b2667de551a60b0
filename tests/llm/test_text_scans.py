"""Licence scans and token counts."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import licenses, token_counts
from graphloom.llm.decontaminate import words_of

SCANNER = licenses.Scanner(licenses.compile_templates(licenses.TEMPLATES))


def filler(rng, n):
    return [f"filler{rng.randrange(500)}" for _ in range(n)]


def test_every_template_is_found_verbatim_and_in_place():
    rng = random.Random(1)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            before = filler(rng, rng.randrange(60))
            doc = " ".join([*before, text, *filler(rng, rng.randrange(60))])
            found = SCANNER([b"", doc.encode(), b"unrelated words only"])
            n = len(words_of(text.encode()))
            assert (name, 1.0, len(before), len(before) + n - 1) in found[1]
            assert found[0] == [] and found[2] == []


def best_containment(words, template):
    k, t = template.k, len(template.shingles)
    shingles = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    size = template.stride * (template.blocks + 2)
    return max((len({s for s in shingles[i : i + size] if s in template.shingles}) / t for i in range(len(shingles))), default=0)


def test_altered_templates_against_brute_force():
    """Edits that leave at least 0.8 of the shingles are found; fewer are not reported."""
    rng = random.Random(2)
    seen = missed = wrong = 0
    for template in SCANNER.templates:
        for _ in range(25):
            words = list(template.words)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = b"edited"
            doc = [w.encode() for w in filler(rng, 30)] + words + [w.encode() for w in filler(rng, 30)]
            names = {r[0] for r in SCANNER([b" ".join(doc)])[0]}
            share = best_containment(doc, template)
            if share >= licenses.THRESHOLD:
                seen += 1
                missed += template.name not in names
            elif all(best_containment(doc, o) < licenses.THRESHOLD for o in SCANNER.templates if o.name == template.name):
                wrong += template.name in names
    assert seen > 80 and missed == 0 and wrong == 0


@pytest.mark.parametrize("n", [1, 4, 5, 300])
def test_index_of_many_templates_retrieves_what_comparing_each_does(n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = {f"L{i}": [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 12, 12, 40])))] for i in range(n)}
    scanner = licenses.Scanner(licenses.compile_templates(texts))
    stream = []
    for own in rng.choices(scanner.templates, k=60):
        stream += rng.choices(vocabulary, k=rng.randrange(20)) + [w.decode() for w in own.words]
    words = np.array([xxhash.xxh64_intdigest(w) for w in stream], np.uint64)
    got = {i: at.tolist() for i, at in scanner.candidates(words).items()}
    want = {}
    for i, t in enumerate(scanner.templates):
        shingles, size = licenses.shingle_hashes(words, t.k), t.stride * t.blocks
        hashes = np.stack([licenses.permuted(shingles, j) for j in range(licenses.BANDS * licenses.ROWS)])
        for first in range(0, len(shingles) - size + 1, t.stride):
            mins = hashes[:, first : first + size].min(axis=1).reshape(licenses.BANDS, licenses.ROWS)
            if (mins[: len(t.mins)] == t.mins).all(axis=1).any():
                want.setdefault(i, []).append(first)
    assert {i: at for i, at in got.items() if at} == want and len(want) >= min(n, 20)


def test_license_odd_rows(spark):
    notice = "Released under the MIT License."
    rows = [(1, None, 1), (2, "", 1), (3, notice, 1), (3, notice, 1), (4, "é " + notice.upper() + "\n" + notice, 1), (None, "All rights reserved.", 1), (5, "word " * 60000 + notice, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int")
    out = [[(s["license"], text[s["start"] : s["end"]].lower()) for s in r["f"]] for r in licenses.scan(df).toDF("doc_id", "text", "x", "f").collect() for text in [r.text or ""]]
    mit = ("MIT", "released under the mit license")
    assert out == [[], [], [mit], [mit], [mit, mit], [("Proprietary", "all rights reserved")], [mit]] or out[4] == [("MIT", "released under the mit license.\nreleased under the mit license")]
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, keep=["doc_id"], templates={}).filter("size(found) > 0").count() == 0


MODEL = token_counts.Unigram.load()


def brute(word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + MODEL.scores[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in MODEL.scores]
        score, pieces = max(options)
        best.append((score, -pieces))
    return best[-1][1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=25), max_size=6))
def test_counts_against_brute_force(texts):
    count = token_counts.Counter(MODEL, kept=8)
    for (n, parts), text in zip(count(texts), texts):
        split = count.split(text)
        assert parts == len(split) and "".join(split) == text and n == sum(brute(w.encode()) for w in split)


def test_shared_prefixes_count_once():
    words = [b"then", b"the", b"them", b"thereby", b"there", b"xyz", b"the"]
    trie = token_counts.Trie(MODEL)
    assert [trie.insert(w) for w in words] == [brute(w) for w in words]
    assert len(trie.best) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)}) == len(trie.next) + 1
    assert sorted(trie.terminal.values()) == sorted(brute(w) for w in set(words))


def test_a_word_that_shares_nothing_counts_the_same(monkeypatch):
    words = [b"thereby", b" international", b"zzzzzzz"]
    monkeypatch.setattr(token_counts, "ALONE", 3)
    assert [token_counts.Trie(MODEL).insert(w) for w in words] == [brute(w) for w in words]


@pytest.mark.parametrize("kept", [1, 10, 400000])
def test_kept_counts_change_nothing(kept):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(50)) for _ in range(6)]
    count = token_counts.Counter(MODEL, kept)
    assert [count([t])[0] for t in texts] == token_counts.Counter(MODEL)(texts)


def test_token_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "hello world", 1), (3, "hello world", 1), (None, "\n\n  \t", 1), (5, "z" * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = [(r.a, r.b) for r in token_counts.token_counts(df).toDF("doc_id", "text", "x", "a", "b").collect()]
    assert out[0] == out[1] == (0, 0) and out[2] == out[3] and out[2][1] == 2 and out[5] == (brute(b"z" * 3000), 1)
    assert token_counts.token_counts(df.limit(0)).count() == 0
