"""Bounded-space online best-fit packing of token sequences.

A packer keeps at most ``open_bins`` open sequences. A bitset holds one bit for each amount of
free space that some open sequence has, so the best fit for a piece is the lowest set bit at or
above its length. When a new sequence would be one too many, the fullest open one closes first.
A task holds back a fixed number of pieces and offers the longest of them first.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.batches import CHUNK_BYTES, lengths, quoted, slices

CAPACITY, END_ID, OPEN_BINS = 1024, 2, 8192
#: Pieces that a task holds back to offer the longer ones first.
LOOKAHEAD = 8192
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: Fixed value: the public pattern that splits a text before the byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a run, with or without spaces, on which the fast encoder may need too much stack or time.
LONG = 1000
#: A split may end here: between a character that is no space and one space before another that is none.
CUT = re.compile(r"(?<=\S)(?= \S)")
SLICE = 1 << 20

_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(tokenizer: str | None = None, ranks: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text as ``tokenizer`` (a tokenizers file) gives them without adding special tokens.

    A faster library encodes by the same ``ranks``. Texts that hold the string of an added token,
    or a run of LONG characters, spaces or none, go to the tokenizer itself, a bounded part at
    a time; parts end where its splitting of any text ends too.
    """
    tokenizer, ranks = tokenizer or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS)
    if tokenizer not in _ENCODERS:
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        whole = Tokenizer.from_file(tokenizer)
        tokens = list(whole.get_added_tokens_decoder().values())
        if any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in tokens):
            raise ValueError("added tokens must not hold or take up space")  # a part could end in one
        added, spaces = [t.content for t in tokens], re.compile(rf"\s{{{LONG}}}")
        fast = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

        def ids(text: str) -> np.ndarray:
            long = len(text) >= LONG and (spaces.search(text) or max(map(len, text.split()), default=0) >= LONG)
            if not long and not any(t in text for t in added):
                return np.array(fast(text), np.uint32)
            parts, at = [], 0
            while at < len(text):
                end = CUT.search(text, at + SLICE)
                stop = end.start() if end else len(text)
                parts.append(np.array(whole.encode(text[at:stop], add_special_tokens=False).ids, np.uint32))
                at = stop
            return np.concatenate([np.empty(0, np.uint32), *parts])

        _ENCODERS[tokenizer] = ids
    return _ENCODERS[tokenizer]


class BestFit:
    """Places pieces of 1 to ``capacity`` tokens; ``place`` returns (sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.n_open, self.sequences = 0, 0, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.capacity, self.sequences
            self.sequences += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_, self.capacity - free


def pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than ``capacity``."""
    first = n % capacity or min(n, capacity)
    out = [(0, first)]
    out += [(s, capacity) for s in range(first, n, capacity)]
    return out


SCHEMA = "k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>"


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    ranks: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Each document is its token ids and then ``end_id``; a null text is an empty one and gives
    the end id alone. The string of an added token in a text is that token, as in the file
    ``tokenizer``. Long texts and runs are taken whole. Rows with equal ids are packed each for
    itself; an id may be null; an empty table gives no rows; other columns may have any names. Of
    open sequences that fit equally well the last one used is taken. Every task packs the rows of its own input split in order, without a shuffle, so
    a task that runs again gives the same rows; sequence ids hold the task's partition above
    40 bits. At most ``open_bins`` sequences a task end partly filled.
    """
    rows = df.select(F.col(quoted(text_col)).cast("string").alias("t"), F.col(quoted(id_col)).alias("k"))
    kind = rows.schema["k"].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)
    if not with_ids:
        schema = schema.removesuffix(", ids array<int>")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        packer, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        keys, held = [], [[] for _ in range(5)]  # piece, start, length, crc, ids

        def flush() -> pa.RecordBatch:
            piece, start, length, crc = (np.array(c, np.int64) for c in held[:4])
            bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for i in np.argsort(-length, kind="stable").tolist():
                bins[i], offsets[i] = packer.place(int(length[i]))
            made = [pa.concat_arrays(keys), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc, base + bins, offsets))]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                made.append(pa.ListArray.from_arrays(ends, np.concatenate(held[4])))
            keys.clear()
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi in slices(lengths(batch.column(0)), CHUNK_BYTES):
                part, row = batch.slice(lo, hi - lo), []
                for i, text in enumerate(part.column(0).to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                    for n, (start, length) in enumerate(pieces(len(ids), capacity)):
                        own = ids[start : start + length]
                        row.append(i)
                        for c, v in zip(held, (n, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None), strict=True):
                            c.append(v)
                keys.append(part.column(1).take(pa.array(row)))
                if len(held[0]) >= LOOKAHEAD:
                    yield flush()
        if keys:
            yield flush()

    return rows.mapInArrow(run, schema).toDF(id_col, *names[1:])


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
