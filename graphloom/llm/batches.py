"""Run a per-text Python function over a DataFrame in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one call of an annotator gets at once; a single longer text comes alone.
CHUNK_BYTES = 4 << 20

Annotator = Callable[[pa.Array], Sequence[pa.Array]]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; 0 for null."""
    size = pc.binary_length(texts.cast(pa.binary()))
    return pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most ``limit``, each with one item at least."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def annotate(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Annotator],
    fields: Sequence[tuple[str, T.DataType]],
    keep: Sequence[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``df``'s columns ``keep`` (all by default), then ``fields`` computed from ``text_col``.

    ``make`` runs once in each task and returns a function from an Arrow string array to one
    array for each field. Rows keep their order and number; there is no shuffle. Columns are
    passed by position, so a kept column may share a name with a field.
    """
    keep = list(df.columns if keep is None else keep)
    inner = df.select(
        F.col(quoted(text_col)).cast("string").alias("t"),
        *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)],
    )
    schema = T.StructType(
        [T.StructField(f"k{i}", inner.schema[f"k{i}"].dataType) for i in range(len(keep))]
        + [T.StructField(f"f{i}", kind) for i, (_, kind) in enumerate(fields)]
    )
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            for start, stop in slices(lengths(batch.column(0)), chunk_bytes):
                part = batch.slice(start, stop - start)
                made = fn(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=names)

    return inner.mapInArrow(run, schema).toDF(*keep, *[name for name, _ in fields])
