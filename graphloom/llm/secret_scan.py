"""Secret scanning: base patterns, and a linear-chain conditional random field over tokens.

The field tags each token as outside, begin or inside of a secret. A token's score for a tag is
the sum of weights of its own shape, of its neighbours' shapes and of the file's kind; Viterbi
finds the best tags of each line. It learns by shape and never by text: from the places where the
base patterns find something, with made-up secrets of many forms and made-up harmless
assignments put in their stead, and so also finds values that the patterns miss.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import annotate, quoted

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # a leftmost run of 24 or more is the whole run
#: What a text with a base finding holds, in Java's syntax.
HIT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
HINTS = ("passw", "secret", "token", "api")

TOKEN = re.compile(r"[\w+/-]+|[^\s\w+/-]+|\n")
OUT, BEGIN, INSIDE = range(3)
NEVER = -30.0
#: Texts with base findings, others, segments from each, tokens in a segment, made-up copies of one with findings: at most.
MAX_WITH, MAX_WITHOUT, MAX_SEGMENTS, SEGMENT, COPIES = 600, 600, 3, 32, 4
#: Characters of a field span at least, and tokens of a chain at most; a longer line is several chains.
MIN_CHARS, CHAIN = 6, 4096
OFFSETS = (0, -1, -2, -3, 1)
FILE_KINDS = 4

#: Words that name secrets, and prefixes of well-known key formats.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential")
PREFIXES = ("AKIA", "ASIA", "ghp_", "xoxb", "sk_live", "eyJ")
#: Fixed values of made-up assignments: names of secrets, of harmless values, signs and quotes.
SECRET_NAMES = ("password", "passwd", "pwd", "db_password", "client_secret", "secret", "token", "auth_token", "api_key", "apikey", "access_key", "private key", "credential", "Bearer")
PLAIN_NAMES = ("name", "id", "date", "version", "url", "title", "page", "count", "path", "color", "user", "row")
SIGNS = ("=", " = ", ": ", ":", " => ", " := ", " ", " is ")
QUOTES = ("", "", "'", '"', "`")

FEATURES = [
    "line", *[f"length{i}" for i in range(7)], *[f"mask{i}" for i in range(32)], "hex", "keyword", "prefix",
    "equals", "colon", "quote", *[f"digits{i}" for i in range(4)], *[f"variety{i}" for i in range(4)],
]
_ID = {name: i for i, name in enumerate(FEATURES)}
_HEX = frozenset("0123456789abcdefABCDEF")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def features(token: str) -> tuple[int, ...]:
    """Numbers of the shape features of one token."""
    if token == "\n":
        return (_ID["line"],)
    n = len(token)
    out = [_ID[f"length{int(np.searchsorted((2, 4, 8, 16, 24, 40), n, side='right'))}"]]
    digit = sum("0" <= c <= "9" for c in token)
    lower, upper, high = any("a" <= c <= "z" for c in token), any("A" <= c <= "Z" for c in token), not token.isascii()
    mark = any(not c.isalnum() for c in token)
    out.append(_ID[f"mask{lower + 2 * upper + 4 * (digit > 0) + 8 * mark + 16 * high}"])
    if n >= 8 and _HEX.issuperset(token):
        out.append(_ID["hex"])
    if not token[0].isalnum() and mark and not lower and not upper:
        out += [_ID[name] for name, chars in (("equals", "="), ("colon", ":"), ("quote", "\"'")) if any(c in token for c in chars)]
    elif n <= 32 and token.lower().endswith(KEYWORDS):
        out.append(_ID["keyword"])
    if token.startswith(PREFIXES):
        out.append(_ID["prefix"])
    if n >= 8:
        out.append(_ID[f"digits{min(3, 4 * digit // n)}"])
        out.append(_ID[f"variety{min(3, len(set(token)) // 4)}"])
    return tuple(out)


class Shapes(dict):
    """Number of each token's shape, made on first sight; ``table`` has each shape's features."""

    LIMIT = 1 << 19

    def __init__(self):
        super().__init__()
        self.numbers, self.table = {}, []
        self["\n"]

    def __missing__(self, token: str) -> int:
        shape = features(token)
        number = self.numbers.get(shape)
        if number is None:
            number = self.numbers[shape] = len(self.table)
            self.table.append(shape)
        if len(token) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[token] = number
        return number


def file_kind(tokens: list[str], text: str) -> int:
    """0 to 3: how much of a file is marks and digits, from prose to dumps."""
    words = max(len(tokens), 1)
    return int(text.count("=") * 20 > words) + 2 * int(text.count("#") + text.count("$") + text.count("{") > words // 8)


@dataclass
class Field:
    """``weights`` (offsets, features, tags), ``moves`` (tags, tags), ``files`` (kinds, tags)."""

    weights: np.ndarray
    moves: np.ndarray
    files: np.ndarray

    def tables(self, table: list[tuple[int, ...]]) -> np.ndarray:
        """(offsets, shapes, tags): summed weights of each shape at each offset."""
        hot = np.zeros((len(table), len(FEATURES)))
        for i, shape in enumerate(table):
            hot[i, list(shape)] = 1
        return np.einsum("sf,oft->ost", hot, self.weights)


def _shifted(shapes: np.ndarray, offset: int) -> np.ndarray:
    """Shape at ``offset`` from each token; beyond the ends a line break, number 0."""
    out = np.zeros_like(shapes)
    if offset == 0:
        return shapes
    if offset < 0:
        out[-offset:] = shapes[:offset]
    else:
        out[:-offset] = shapes[offset:]
    return out


def viterbi(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Best tags of each chain ``scores[start:stop]``; all chains advance together."""
    tags = np.zeros(len(scores), np.int8)
    order = np.argsort(starts - stops, kind="stable")
    starts, lengths = starts[order], (stops - starts)[order]
    if not len(lengths) or lengths[0] == 0:
        return tags
    back = np.zeros((len(scores), 3), np.int8)
    best = scores[starts] + np.array([0.0, 0.0, NEVER])
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    ends = np.empty((len(starts), 3))
    for t in range(1, int(lengths[0])):
        n = alive[t]
        ends[n : len(best)] = best[n:]
        paths = best[:n, :, None] + moves
        came = paths.argmax(axis=1)
        at = starts[:n] + t
        back[at] = came
        best = np.take_along_axis(paths, came[:, None, :], axis=1)[:, 0, :] + scores[at]
    ends[: len(best)] = best
    last = ends.argmax(axis=1).astype(np.int8)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        tags[at] = last[:n]
        last[:n] = back[at, last[:n]]
    return tags


class Tagger:
    """Tags whole texts with a field; shapes and their tables grow as new ones turn up."""

    def __init__(self, field: Field):
        self.field, self.shapes, self.known = field, Shapes(), np.zeros((len(OFFSETS), 0, 3))
        gain = max(0.0, float((field.moves - field.moves[OUT, OUT]).max()))
        self.cold = -2 * gain - 1e-9  # lines of tokens that all gain less than this stay outside

    def tag(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(text's number, spans) of the texts in which the field tags anything."""
        stream, bounds, kinds = [], [0], []
        for text in texts:
            tokens = TOKEN.findall(text)
            kinds.append(file_kind(tokens, text))
            stream += tokens
            stream.append("\n")
            bounds.append(len(stream))
        shapes = np.fromiter(map(self.shapes.__getitem__, stream), np.int32, len(stream))
        if len(self.shapes.table) > self.known.shape[1]:
            self.known = self.field.tables(self.shapes.table)
        scores = np.repeat(self.field.files[kinds], np.diff(bounds), axis=0)
        for table, offset in zip(self.known, OFFSETS, strict=True):
            scores += table[_shifted(shapes, offset)]
        warm = (scores[:, 1:].max(axis=1) - scores[:, OUT] > self.cold) & (shapes != 0)
        breaks = np.flatnonzero(shapes == 0)
        starts = np.concatenate(([0], breaks[:-1] + 1))
        counts = np.maximum(1, -(-(breaks - starts) // CHAIN))
        if counts.max() > 1:
            part = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts, ends = np.repeat(starts, counts) + part * CHAIN, np.repeat(breaks, counts)
            breaks = np.minimum(starts + CHAIN, ends)
        warmth = np.concatenate(([0], np.cumsum(warm)))
        live = warmth[breaks] > warmth[starts]
        tags = viterbi(scores, self.field.moves, starts[live], breaks[live])
        marked = np.flatnonzero(tags)
        if not len(marked):
            return
        for i in np.unique(np.searchsorted(bounds, marked, side="right") - 1).tolist():
            spans: list[tuple[int, int]] = []
            own = tags[bounds[i] : bounds[i + 1] - 1]
            for tag, m in zip(own.tolist(), TOKEN.finditer(texts[i]), strict=True):
                if tag == BEGIN or (tag == INSIDE and not spans):
                    spans.append(m.span())
                elif tag == INSIDE:
                    spans[-1] = (spans[-1][0], m.end())
            yield i, spans


def _outside(span: tuple[int, int], base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of ``span`` that lie in none of ``base``, which is sorted by start."""
    (start, end), out = span, []
    for a, b in base:
        if a < end and b > start:
            out.append((start, a))
            start = b
    return [(a, b) for a, b in [*out, (start, end)] if a < b]


def find(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text, kind 3 for what only the field finds, by start and kind.

    Of a field span that overlaps base spans, the parts outside them count.
    """
    out = [base_spans(t) for t in texts]
    for i, spans in tagger.tag(texts):
        base = [(a, b) for a, _, b in out[i]]
        more = [(a, 3, b) for span in spans for a, b in _outside(span, base) if b - a >= MIN_CHARS]
        out[i] = sorted(out[i] + more)
    return out


def made_up_secret(rng: random.Random) -> str:
    """A value as secrets have it: hexadecimal, letters and digits, a known prefix, a password."""
    pick = lambda chars, low, high: "".join(rng.choices(chars, k=rng.randrange(low, high)))
    both, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    kind = rng.randrange(6)
    if kind == 0:
        return pick("0123456789abcdef", 16, 65)
    if kind == 1:
        return pick("0123456789ABCDEF", 16, 41)
    if kind == 2:
        return pick(both, 10, 45)
    if kind == 3:
        return pick(both + "+/", 20, 60) + "=" * rng.randrange(3)
    if kind == 4:
        return rng.choice(PREFIXES) + (pick(upper, 16, 17) if rng.random() < 0.5 else pick(both, 16, 37))
    word = pick(string.ascii_lowercase, 4, 9)
    return (word.title() if rng.random() < 0.5 else word) + rng.choice(("", "", "!", "#", "_", "-")) + pick(string.digits, 2, 5) + rng.choice(("", "", "!", "x", "Ab"))


def made_up_value(rng: random.Random) -> str:
    """A value that is no secret: a word, a number, a date, a version, an address, a path."""
    word = "".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 14)))
    number = rng.randrange(10 ** rng.randrange(1, 13))
    forms = (word, word.title(), word.upper(), str(number), f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}",
        f"{rng.randrange(9)}.{rng.randrange(99)}.{rng.randrange(99)}", f"/{word}/{word[::-1]}", f"{word}-{word[::-1]}", f"{word}{number % 100}", f"https://www.{word}.org/{number % 1000}")
    return rng.choice(forms)


def _made_up(tokens: list[str], tags: list[int], secret: bool, rng: random.Random) -> tuple[list[str], list[int]]:
    """The segment with another assignment in place of each secret and its name, and its tags."""
    out, marks, i = [], [], 0
    while i < len(tokens):
        if not tags[i]:
            out.append(tokens[i])
            marks.append(OUT)
            i += 1
            continue
        while i < len(tokens) and tags[i]:
            i += 1
        back = len(out)
        while back and len(out) - back < 3 and not out[back - 1][-1].isalnum() and out[back - 1] != "\n":
            back -= 1
        named = back > 0 and _ID["keyword"] in features(out[back - 1])
        if named:
            del out[back - 1 :], marks[back - 1 :]
        quote, value = rng.choice(QUOTES), made_up_secret(rng) if secret else made_up_value(rng)
        if not secret or len(value) < 16 or rng.random() < 0.7:  # longer ones also stand alone
            before = TOKEN.findall(rng.choice(SECRET_NAMES if secret else PLAIN_NAMES) + rng.choice(SIGNS) + quote)
            out += before
            marks += [OUT] * len(before)
        inner = TOKEN.findall(value)
        out += inner
        marks += [BEGIN, *[INSIDE] * (len(inner) - 1)] if secret else [OUT] * len(inner)
        if quote:
            out.append(quote)
            marks.append(OUT)
    return out, marks


def segments(
    text: str, shapes: Shapes, max_segments: int = MAX_SEGMENTS, size: int = SEGMENT, copies: int = COPIES
) -> list[tuple[list[int], list[int], int]]:
    """(shapes, tags, file kind) of up to ``max_segments`` pieces of a text, those with secrets first.

    A piece with a secret comes as it is, ``copies`` times with a made-up secret in place of each,
    and once with harmless values there. What is made up depends on the text alone.
    """
    places = list(TOKEN.finditer(text))
    tags = np.zeros(len(places), np.int64)
    begins = np.array([m.start() for m in places])
    for start, kind, end in base_spans(text):
        if kind == 0:
            start += ASSIGN.match(text[start:end]).start(2)
        first, stop = int(np.searchsorted(begins, start, side="right")) - 1, int(np.searchsorted(begins, end))
        first += places[first].end() <= start
        tags[first:stop] = INSIDE
        if first < stop:
            tags[first] = BEGIN
    tokens = [m[0] for m in places]
    tags[[i for i, t in enumerate(tokens) if t == "\n"]] = OUT
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    kind, out = file_kind(tokens, text), []
    order = sorted(range(0, len(tokens), size), key=lambda c: (-int(tags[c : c + size].any()), (c * 2654435761) % (1 << 32)))
    for c in order[:max_segments]:
        own, marks = tokens[c : c + size], tags[c : c + size].tolist()
        made = [(own, marks)]
        if any(marks):
            made += [_made_up(own, marks, n < copies, rng) for n in range(copies + 1)]
        out += [([shapes[t] for t in some], own_marks, kind) for some, own_marks in made]
    return out


def marginals(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tag probabilities, expected transitions, log of the sum over all paths) by forward-backward.

    ``scores`` is (steps, chains, tags) and ``mask`` (steps, chains) says which steps a chain has: a
    first part of one step or more. Products are kept in range by a factor for each step.
    """
    steps = len(scores)
    top = scores.max(axis=2)
    local = np.exp(scores - top[:, :, None])
    step = np.exp(moves)
    forward, factor = np.empty_like(local), np.ones(scores.shape[:2])
    forward[0] = local[0] * np.exp([0.0, 0.0, NEVER])
    factor[0] = forward[0].sum(axis=1)
    forward[0] /= factor[0][:, None]
    for t in range(1, steps):
        new = (forward[t - 1] @ step) * local[t]
        factor[t] = np.where(mask[t], new.sum(axis=1), 1.0)
        forward[t] = np.where(mask[t][:, None], new / factor[t][:, None], forward[t - 1])
    backward, expected = np.ones_like(local), np.zeros((3, 3))
    for t in range(steps - 1, 0, -1):
        ahead = np.where(mask[t][:, None], local[t] * backward[t] / factor[t][:, None], 0.0)
        expected += step * (forward[t - 1].T @ ahead)
        backward[t - 1] = np.where(mask[t][:, None], ahead @ step.T, 1.0)
    total = (np.where(mask, np.log(factor) + top, 0.0)).sum(axis=0)
    return np.where(mask[:, :, None], forward * backward, 0.0), expected, total


def fit(rows: list[tuple[list[int], list[int], int]], table: list[tuple[int, ...]], steps: int = 90, rate: float = 0.2, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam on exact forward-backward gradients over all segments.

    Without any tagged token, a field that tags nothing.
    """
    field = Field(np.zeros((len(OFFSETS), len(FEATURES), 3)), np.zeros((3, 3)), np.zeros((FILE_KINDS, 3)))
    field.moves[OUT, INSIDE] = NEVER
    rows = [r for r in rows if r[0]]
    if not any(any(tags) for _, tags, _ in rows):
        field.files[:, OUT] = -NEVER
        return field
    n, length, reach = len(rows), max(len(s) for s, _, _ in rows), max(map(abs, OFFSETS))
    shapes, gold, mask = np.zeros((length, n), np.int64), np.zeros((length, n), np.int64), np.zeros((length, n), bool)
    for i, (s, t, _) in enumerate(rows):
        shapes[: len(s), i], gold[: len(s), i], mask[: len(s), i] = s, t, True
    kinds = np.array([k for _, _, k in rows])
    wide = np.pad(shapes, ((reach, reach), (0, 0)))
    near = [wide[reach + o : reach + o + length] for o in OFFSETS]
    hot = np.zeros((len(table), len(FEATURES)))
    for i, shape in enumerate(table):
        hot[i, list(shape)] = 1
    truth = np.eye(3)[gold] * mask[:, :, None]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (gold[:-1][mask[1:]], gold[1:][mask[1:]]), 1)
    params = [field.weights, field.moves, field.files]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        scores = np.broadcast_to(field.files[kinds], (length, n, 3)) + sum((hot @ field.weights[o])[near[o]] for o in range(len(OFFSETS)))
        found, expected, _ = marginals(scores, mask, field.moves)
        gap = found - truth
        flat = gap.reshape(-1, 3)
        by_shape = [np.stack([np.bincount(x.ravel(), flat[:, k], len(table)) for k in range(3)], 1) for x in near]
        by_file = np.stack([np.bincount(kinds, gap.sum(axis=0)[:, k], FILE_KINDS) for k in range(3)], 1)
        grads = [np.stack([hot.T @ g for g in by_shape]), expected - pairs, by_file]
        grads[1][OUT, INSIDE] = 0
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g / n + l2 * np.where(p == NEVER, 0, p)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def _least(n_with: int, n_without: int):
    """Over rows (h, hit): the least ``n_with`` and ``n_without`` distinct hashes of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {True: np.empty(0, np.int64), False: np.empty(0, np.int64)}
        for batch in batches:
            h, hit = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for kind, n in ((True, n_with), (False, n_without)):
                least[kind] = np.unique(np.concatenate((least[kind], h[hit == kind])))[:n]
        for kind, hashes in least.items():
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.full(len(hashes), kind))], names=["h", "hit"])

    return run


def train(
    df: DataFrame,
    text_col: str = "text",
    max_with: int = MAX_WITH,
    max_without: int = MAX_WITHOUT,
    max_segments: int = MAX_SEGMENTS,
    segment: int = SEGMENT,
    copies: int = COPIES,
) -> Field:
    """Fit on segments of at most ``max_with`` texts that a base pattern matches and ``max_without`` others.

    Both samples are those of the least text hashes, so a run gives the same field every time; copies
    of a text count once. Of each text at most ``max_segments`` pieces of ``segment`` tokens are used.
    Executors turn the texts into shapes; the driver gets short lists of numbers. Null and empty
    texts are left out; without any finding, or any row, the field tags nothing.
    """
    texts = df.select(F.col(quoted(text_col)).cast("string").alias("t")).filter(F.length("t") > 0).withColumn("h", F.xxhash64("t"))
    hits = texts.select("h", F.col("t").rlike(HIT).alias("hit")).mapInArrow(_least(max_with, max_without), "h long, hit boolean")
    hits = hits.distinct().collect()  # at most (max_with + max_without) numbers a task
    chosen = [sorted(r.h for r in hits if r.hit == kind)[:n] for kind, n in ((True, max_with), (False, max_without))]
    chosen = df.sparkSession.createDataFrame([(h,) for h in sorted({*chosen[0], *chosen[1]})], "h long")
    chosen = texts.join(F.broadcast(chosen), "h").select("h", "t").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            rows = [s for t in batch.column(1).to_pylist() for s in segments(t, shapes, max_segments, segment, copies)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([[shapes.table[n] for n in s] for s, _, _ in rows], pa.list_(pa.list_(pa.int32()))),
                        pa.array([t for _, t, _ in rows], pa.list_(pa.int32())),
                        pa.array([k for _, _, k in rows], pa.int32()),
                    ],
                    names=["shapes", "tags", "kind"],
                )

    found = chosen.mapInArrow(run, "shapes array<array<int>>, tags array<int>, kind int")
    rows = sorted((tuple(map(tuple, s)), tuple(t), k) for s, t, k in found.toLocalIterator())
    numbers: dict[tuple[int, ...], int] = {(_ID["line"],): 0}
    parsed = [([numbers.setdefault(x, len(numbers)) for x in s], list(t), k) for s, t, k in rows]
    return fit(parsed, list(numbers))


SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end")]))


def secrets(df: DataFrame, field: Field, text_col: str = "text", keep=None) -> DataFrame:
    """``df``'s columns ``keep``, then ``found``: array<struct<start,kind,end>> of each text.

    Kinds are numbers of KINDS and 3 for what only the field tags, if it has MIN_CHARS characters or
    more outside base spans. Null and empty texts have none; repeated rows have theirs each; an
    empty table gives no rows; other columns may have any names. Of equally good tags the lower
    number wins. Texts are taken whole; a line of over CHAIN tokens is decoded as several, so a
    field span ends there. The field is broadcast: a few thousand numbers whatever the input.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)

    def make():
        tagger = Tagger(shared.value)

        def run(texts: pa.Array):
            found = find(tagger, [t or "" for t in texts.to_pylist()])
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")]))
            return [pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in spans] for spans in found], kind)]

        return run

    return annotate(df, text_col, make, [("found", SPANS)], keep=keep, chunk_bytes=2 << 20)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secrets(docs, train(docs), keep=["doc_id"])
    names = F.array(*[F.lit(k) for k in (*KINDS, "field")])
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(F.array_join(F.transform(F.filter("found", lambda s: s["kind"] < 3), text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", text), ",").alias("spans"),
    )
