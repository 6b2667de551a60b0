import random
import struct
import zlib
from collections import defaultdict
from unittest.mock import patch

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "<|endoftext|", " ", "\n\n", " " * 1200, "a" * 1100, "=" * 1001, "7" * 1000, "\u3000"]))


def exact(text):
    return EXACT.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=8).map("".join))
def test_ids_equal_those_of_the_tokenizer_file(text):
    assert packing.encoder()(text).tolist() == exact(text)


def test_ids_of_added_tokens():
    assert packing.encoder()("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


@settings(max_examples=12, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_ids_do_not_depend_on_the_parts(text):
    with patch.object(packing, "SLICE", 7), patch.object(packing, "LONG", 0), patch.object(packing, "_ENCODERS", {}):
        assert packing.encoder()(text).tolist() == exact(text)


@pytest.mark.parametrize("unit", [" ", "\n", "x", " \t\n"])
def test_long_runs(spark, unit):
    text = "begin" + unit * (5_000_000 // len(unit)) + "end"
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), with_ids=False).collect()
    one = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    ids = [*exact(text), 2]
    assert sum(r.length for r in one) == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in one)


def test_pieces():
    assert packing.pieces(1) == [(0, 1)]
    assert packing.pieces(1024) == [(0, 1024)]
    assert packing.pieces(1025) == [(0, 1), (1, 1024)]
    assert packing.pieces(2048) == [(0, 1024), (1024, 1024)]


class Slow:
    """Best fit by looking at every open bin."""

    def __init__(self, capacity, open_bins):
        self.capacity, self.limit, self.open, self.n = capacity, open_bins, {}, 0

    def place(self, length):
        fits = [free for free in self.open.values() if free >= length]
        if fits:
            free = min(fits)
            bin_ = [b for b, f in self.open.items() if f == free][-1]
            del self.open[bin_]
        else:
            if len(self.open) >= self.limit:
                fullest = min(self.open.values())
                del self.open[[b for b, f in self.open.items() if f == fullest][-1]]
            bin_, free = self.n, self.capacity
            self.n += 1
        if free > length:
            self.open[bin_] = free - length
        return bin_, self.capacity - free


@pytest.mark.parametrize("open_bins", [1, 3, 20])
def test_best_fit_against_a_plain_one(open_bins):
    rng = random.Random(open_bins)
    fast, slow = packing.BestFit(64, open_bins), Slow(64, open_bins)
    for _ in range(800):
        n = rng.randrange(1, 65)
        a, b = fast.place(n), slow.place(n)
        assert a[1] == b[1] and fast.n_open == len(slow.open) <= open_bins


DOCS = [(1, "hello world"), (2, None), (3, ""), (4, "many words " * 1500), (5, "x" * 40000), (6, "ünïcode 日本語 \U0001f600 <|endoftext|>"), (6, "again"), (None, "no id")]


@pytest.mark.parametrize("partitions", [1, 3])
def test_pack_round_trip(spark, tokenizer, partitions):
    docs = DOCS + [(100 + i, "some text here " * (i % 90)) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    rows = packing.pack(df).collect()
    room = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) and r.length == len(r.ids)
        room[r.sequence_id].append((r.offset, r.length))
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    wanted = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in docs)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    got = []
    for own in by_doc.values():
        firsts = [r for r in own if r.piece == 0]
        if len(firsts) > 1:  # rows with one id: short ones here, a piece each
            got += [tuple(r.ids) for r in own]
        else:
            own.sort(key=lambda r: r.piece)
            assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
            assert all(r.length == 1024 for r in own[1:])
            got.append(tuple(i for r in own for i in r.ids))
    assert sorted(got) == wanted
    tokens = sum(r.length for r in rows)
    assert len(room) <= 1.1 * tokens / 1024 + partitions


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df).count() == 0
    odd = spark.createDataFrame([("a", "t", 7)], "id string, body string, offset int")
    assert packing.pack(odd, "id", "body", with_ids=False).columns == ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
