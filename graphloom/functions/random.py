"""Randomness from hashes of row content: the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """A double in [0, 1) from ``keys``: 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) * F.lit(2.0**-53)


def permute_columns(df: DataFrame, columns: list[str], n: int, seed: int, rounds: int = 4) -> DataFrame:
    """``df`` with one permutation of 0 to ``n`` - 1 applied to each of ``columns``.

    A Feistel network permutes the 2^b values of the least b that holds ``n``. An image outside
    is mapped again until it is inside; each turn leaves under half outside, and after 64 turns
    one in 2^64. Each round is a projection of its own, as it uses its input twice.
    """
    if n < 2:
        return df
    bits = (n - 1).bit_length()
    low = bits - bits // 2
    high_mask, low_mask = (1 << (bits - low)) - 1, (1 << low) - 1

    def turn(x: Column, r: int) -> Column:
        high, rest = F.shiftrightunsigned(x, low), x.bitwiseAND(low_mask)
        if r % 2:
            return F.shiftleft(high, low).bitwiseOR(rest.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(r), high).bitwiseAND(low_mask)))
        return F.shiftleft(high.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(r), rest).bitwiseAND(high_mask)), low).bitwiseOR(rest)

    def again(x: Column) -> Column:
        for r in range(rounds):
            x = turn(x, r)
        return x

    df = df.withColumns({c: F.col(c).cast("long") for c in columns})
    for r in range(rounds):
        df = df.withColumns({c: turn(F.col(c), r) for c in columns})
    if n == 1 << bits:
        return df
    walk = lambda c: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.col(c), lambda x, _: F.when(x >= n, again(x)).otherwise(x))
    return df.withColumns({c: F.when(F.col(c) >= n, walk(c)).otherwise(F.col(c)) for c in columns})
