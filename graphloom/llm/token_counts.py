"""Token counts by dynamic programming on a trie of distinct pre-tokens.

Each piece of the vocabulary has a unigram score, -log(rank + 1) less a constant: the public
rank file orders pieces by frequency, which follows Zipf's law. A pre-token's count is that of
its best-scoring split into pieces. The distinct new pre-tokens of a batch go into a trie; a
node's forward score is computed once, when it is made, whatever shares that prefix, and the
node at a pre-token's end stores its count. Counts are kept for later texts.
"""

from __future__ import annotations

import base64
import math

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.batches import annotate
from graphloom.llm.packing import PATTERN, RANKS

#: Pre-tokens whose counts a worker keeps; beyond it starts anew, with the same results.
KEPT = 400_000
#: Bytes of a pre-token above which it shares no prefix in the trie; its count is the same.
ALONE = 4096


class Unigram:
    """Piece scores from a rank file; ``suffixes`` holds every suffix of a piece."""

    def __init__(self, ranks: dict[bytes, int]):
        norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.scores = {piece: -math.log(r + 1) - norm for piece, r in ranks.items()}
        self.suffixes = {piece[i:] for piece in ranks for i in range(len(piece))}

    @classmethod
    def load(cls, ranks: str | None = None) -> Unigram:
        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def forward(self, word: bytes, end: int, path: list[int], best: list[float], count: list[int]) -> tuple[float, int]:
        """Best score of ``word[:end]`` and the pieces of that split; of equal scores the fewest pieces.

        ``best`` and ``count`` have those of the shorter prefixes, at the numbers in ``path``.
        """
        scores, suffixes = self.scores, self.suffixes
        top, pieces = -math.inf, 0
        for start in range(end - 1, -1, -1):
            piece = word[start:end]
            if piece not in suffixes:
                break
            score = scores.get(piece)
            if score is not None:
                at = path[start]
                total = best[at] + score
                if total > top or (total == top and count[at] + 1 < pieces):
                    top, pieces = total, count[at] + 1
        return top, pieces


class Trie:
    """Prefixes of words: node 0 is the empty one, ``next`` maps (node, byte) to a child.

    ``best`` and ``count`` are each node's forward score, ``terminal`` the counts at words' ends.
    """

    def __init__(self, model: Unigram):
        self.model, self.next, self.best, self.count, self.terminal = model, {}, [0.0], [0], {}

    def insert(self, word: bytes) -> int:
        """The count of ``word``; only nodes that are not there yet are made and scored."""
        if len(word) > ALONE:
            path, best, count = range(len(word) + 1), [0.0], [0]
            for end in range(1, len(word) + 1):
                score, pieces = self.model.forward(word, end, path, best, count)
                best.append(score)
                count.append(pieces)
            return count[-1]
        node, path = 0, [0]
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = self.next.get(key)
            if node is None:
                node = self.next[key] = len(self.best)
                score, pieces = self.model.forward(word, end, path, self.best, self.count)
                self.best.append(score)
                self.count.append(pieces)
            path.append(node)
        self.terminal[node] = self.count[node]
        return self.terminal[node]


class Counter:
    """Counts whole texts; the terminal counts of pre-tokens seen so far are kept."""

    def __init__(self, model: Unigram, kept: int = KEPT):
        self.model, self.kept, self.known = model, kept, {}
        self.split = regex.compile(PATTERN).findall

    def __call__(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        parts = [self.split(t) for t in texts]
        known = self.known
        new = set().union(*parts).difference(known)
        if len(known) + len(new) > self.kept:
            known.clear()
            new = set().union(*parts)
        trie = Trie(self.model)
        known.update((w, trie.insert(w.encode("utf-8"))) for w in new)
        return [(sum(map(known.__getitem__, p)), len(p)) for p in parts]


_MODELS: dict[str | None, Counter] = {}


def token_counts(df: DataFrame, text_col: str = "text", keep=None, ranks: str | None = None) -> DataFrame:
    """``df``'s columns ``keep``, then n_tokens and n_pretokens; null and empty texts have none.

    Repeated rows count each for itself; an empty table gives no rows; columns may have any names.
    Texts are taken whole, however long. Of equally good splits the one with fewer pieces counts.
    """

    def make():
        if ranks not in _MODELS:  # a worker that serves several tasks keeps its counts
            _MODELS[ranks] = Counter(Unigram.load(ranks))
        count = _MODELS[ranks]

        def run(texts: pa.Array):
            found = count([t or "" for t in texts.to_pylist()])
            return [pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]

        return run

    return annotate(df, text_col, make, [("n_tokens", T.LongType()), ("n_pretokens", T.LongType())], keep=keep, chunk_bytes=2 << 20)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
