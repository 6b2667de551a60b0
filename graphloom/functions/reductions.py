"""Group reductions: one value for each group, or that value on every row of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDUCTIONS = {"min": F.min, "max": F.max, "sum": F.sum, "or": F.bit_or, "any": F.bool_or}


def _reducer(name: str):
    if name not in REDUCTIONS:
        raise ValueError(f"no reduction {name!r}; there are {sorted(REDUCTIONS)}")
    return REDUCTIONS[name]


def reduce_groups(df: DataFrame, group: str, values: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each ``group``; ``values`` maps output names to (reduction, column)."""
    return df.groupBy(group).agg(*[_reducer(how)(column).alias(out) for out, (how, column) in values.items()])


def reduce_all(df: DataFrame, group: str, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Every row with its group's value: the reduction joined back, so groups are never sorted."""
    return df.join(reduce_groups(df, group, values), group)


def reduce_window(name: str, column: str, group: str) -> Column:
    """The group's value as a window expression, for groups that fit a task."""
    return _reducer(name)(column).over(Window.partitionBy(group))


def salted_reduce(df: DataFrame, key: str, values: dict[str, tuple[str, str]], salts: int, salt_by: Column) -> DataFrame:
    """Two-level reduction: by (key, salt) and then by key, for keys too hot for one reducer."""
    salted = df.withColumn("_salt", F.pmod(salt_by, F.lit(salts)))
    partial = salted.groupBy(key, "_salt").agg(*[_reducer(how)(column).alias(out) for out, (how, column) in values.items()])
    return partial.groupBy(key).agg(*[_reducer(how)(out).alias(out) for out, (how, _) in values.items()])
