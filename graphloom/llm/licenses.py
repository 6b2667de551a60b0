"""Licence scans: MinHash bands over overlapping windows, then exact shingle containment.

A template of t shingles is sought in windows of about t shingles, one starting every t/8
(every word for short templates). BANDS bands of ROWS min-hashes retrieve the windows that may
hold it. A window with a containment of 0.8, cut by as much as half a stride, has a Jaccard
similarity of at least 0.58, so it is retrieved with probability 1 - (1 - 0.58^2)^16 = 0.998;
a verbatim copy with more than 0.99999. Containment is then checked on the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import annotate
from graphloom.llm.decontaminate import merged, offsets, words_of

SHINGLE_WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 2

#: Public notices by licence identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    pair = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    return pair[0] | np.uint64(1), pair[1]


_MUL, _ADD = _permutations()


class WordHashes(dict):
    """64-bit hash of each word; bounded, and the same after it starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each k words."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def permuted(shingles: np.ndarray, j: int) -> np.ndarray:
    return ((shingles * _MUL[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Template:
    name: str
    words: list[bytes]
    k: int
    stride: int
    blocks: int
    mins: np.ndarray  # (bands, rows)

    @property
    def shingles(self) -> set[tuple[bytes, ...]]:
        return {tuple(self.words[i : i + self.k]) for i in range(len(self.words) - self.k + 1)}


def compile_templates(templates: dict[str, list[str]]) -> list[Template]:
    """Templates with their window shapes and band keys; one without words is left out."""
    out = []
    for name, texts in sorted(templates.items()):
        for text in texts:
            words = words_of(text.encode("utf-8"))
            if not words:
                continue
            k = min(SHINGLE_WORDS, len(words))
            hashes = shingle_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), k)
            mins = np.array([permuted(hashes, j).min() for j in range(BANDS * ROWS)], np.uint32).reshape(BANDS, ROWS)
            if THRESHOLD * len(hashes) > len(hashes) - 1:
                mins = mins[:1]  # only equal sets can pass, and those share every band
            stride = max(1, len(hashes) // 8)
            out.append(Template(name, words, k, stride, -(-len(hashes) // stride), mins))
    return out


def _window_mins(blocks: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """Least of each ``width`` values in a row, for all widths from shared powers of two."""
    out, step = {}, 1
    for width in sorted(widths):
        while step * 2 <= width:
            blocks = np.minimum(blocks[:-step], blocks[step:])
            step *= 2
        rest = width - step
        out[width] = np.minimum(blocks[:-rest], blocks[rest:]) if rest else blocks
    return out


class BandIndex:
    """The templates of one window shape by one band's min-hashes."""

    def __init__(self, keys: list[tuple[int, tuple[int, ...]]]):
        self.templates: dict[tuple[int, ...], list[int]] = {}
        for i, key in keys:
            self.templates.setdefault(key, []).append(i)
        self.first = np.array(sorted({key[0] for key in self.templates}), np.uint32)
        self.maybe = np.zeros(1 << 12, bool)
        self.maybe[self.first >> np.uint32(20)] = True

    def places(self, mins: np.ndarray) -> np.ndarray:
        """Where the band's first min-hash is that of some template; few are compared, not looked up."""
        if len(self.first) <= 4:
            return np.flatnonzero(reduce(np.logical_or, [mins == key for key in self.first]))
        at = np.flatnonzero(self.maybe[mins >> np.uint32(20)])
        near = np.minimum(np.searchsorted(self.first, mins[at]), len(self.first) - 1)
        return at[self.first[near] == mins[at]]


class Scanner:
    """Finds templates in texts, all of a batch as one stream with a gap between texts.

    A window is looked up once in each band's index, however many templates there are; their
    number adds index entries, and window shapes up to those of their lengths.
    """

    def __init__(self, templates: list[Template]):
        self.templates, self.hashes = templates, WordHashes()
        self.gap = max((t.k for t in templates), default=1) + max((t.stride * (t.blocks + 2) for t in templates), default=1)
        keys: dict[tuple[int, int, int, int], list] = {}
        for i, t in enumerate(templates):
            for band, mins in enumerate(t.mins.tolist()):
                keys.setdefault((t.k, band, t.stride, t.blocks), []).append((i, tuple(mins)))
        #: For each k, band and stride: the index of each number of blocks.
        self.index: dict[int, dict[int, dict[int, dict[int, BandIndex]]]] = {}
        for (k, band, stride, blocks), own in sorted(keys.items()):
            self.index.setdefault(k, {}).setdefault(band, {}).setdefault(stride, {})[blocks] = BandIndex(own)

    def candidates(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """First shingles of the windows that share a band with each template, by its number."""
        hits: dict[int, list] = {}
        for k, bands in self.index.items():
            shingles = shingle_hashes(words, k)
            for band, strides in bands.items():
                first = permuted(shingles, band * ROWS)
                for stride, shapes in strides.items():
                    widths = [w for w in shapes if len(shingles) >= stride * w]
                    whole = len(first) // stride * stride
                    least = first[:whole].reshape(-1, stride).min(axis=1) if stride > 1 else first
                    for width, mins in _window_mins(least, widths).items():
                        index = shapes[width]
                        at = index.places(mins)
                        if not len(at):
                            continue
                        key, at = [mins[at]], at * stride
                        own = shingles[at[:, None] + np.arange(stride * width)]
                        key += [permuted(own, band * ROWS + r).min(axis=1) for r in range(1, ROWS)]
                        kinds, which = np.unique(np.stack(key, axis=1), axis=0, return_inverse=True)
                        for n, kind in enumerate(map(tuple, kinds.tolist())):
                            for i in index.templates.get(kind, ()):
                                hits.setdefault(i, []).append(at[which == n])
        return {i: np.unique(np.concatenate(parts)) for i, parts in hits.items()}

    def __call__(self, texts: list[bytes]) -> list[list[tuple[str, float, int, int]]]:
        """(licence, containment, first word, last word) of each text, sorted."""
        words = [words_of(t) for t in texts]
        starts, stream, at = [], [], 0
        for w in words:
            starts.append(at)
            stream += map(self.hashes.__getitem__, w)
            stream += range(self.gap)
            at += len(w) + self.gap
        stream_words = np.array(stream, np.uint64)
        out: list[dict[str, list]] = [{} for _ in texts]
        for i, firsts in self.candidates(stream_words).items():
            template = self.templates[i]
            wanted = template.shingles
            size = template.stride * template.blocks
            middles = firsts + size // 2
            for first, text in zip(firsts.tolist(), (np.searchsorted(starts, middles, side="right") - 1).tolist(), strict=True):
                own, lo = words[text], first - starts[text] - template.stride
                spots = range(max(lo, 0), min(lo + size + 2 * template.stride, len(own) - template.k + 1))
                same = [p for p in spots if tuple(own[p : p + template.k]) in wanted]
                share = len({tuple(own[p : p + template.k]) for p in same}) / len(wanted)
                if share >= THRESHOLD:
                    out[text].setdefault(template.name, []).append((share, same[0], same[-1] + template.k - 1))
        result = []
        for found in out:
            rows = []
            for name, spans in found.items():
                for a, b in merged([(a, b) for _, a, b in spans]):
                    rows.append((name, max(s for s, x, y in spans if a <= x and y <= b), a, b))
            result.append(sorted(rows))
        return result


FOUND = T.ArrayType(
    T.StructType(
        [T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
)


def scan(df: DataFrame, text_col: str = "text", keep=None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``df``'s columns ``keep``, then ``found``: the licence notices of each text.

    Each has its licence, the share of the template's shingles found, and its character span; they
    are sorted by licence and place, and notices of one licence that touch are one.
    Templates of under five words are one shingle. Null, empty and word-less texts have none, as
    do all texts without templates; repeated rows stay, and an empty table gives no rows. Texts
    are taken whole, a longer one than 1 MB alone; other columns may have any names.
    """
    texts = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(compile_templates(texts))

        def run(column: pa.Array):
            data = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
            rows = []
            for text, found in zip(data, scanner(data), strict=True):
                places = offsets(text.decode("utf-8"), [(a, b) for _, _, a, b in found]) if found else []
                rows.append([{"license": n, "containment": c, **p} for (n, c, _, _), p in zip(found, places, strict=True)])
            kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
            return [pa.array(rows, kind)]

        return run

    return annotate(df, text_col, make, [("found", FOUND)], keep=keep, chunk_bytes=1 << 20)


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    span = lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda s: s["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["containment"])), F.lit(0.0)).alias("containment"),
        F.array_join(F.transform("found", span), ",").alias("spans"),
    )
