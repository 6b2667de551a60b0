"""Media columns: JPEG bytes as a binary column, and features read back from them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import CHUNK_BYTES, annotate, lengths, quoted, slices
from graphloom.llm.jpeg import ROW, JpegError, average_hash, encode, images_of, thumbnails


def padded(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of ROW bytes."""
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" ")


def store(df: DataFrame, text_col: str = "text", keep=None, name: str = "media") -> DataFrame:
    """``df``'s columns ``keep`` and each text's UTF-8 bytes, padded, as JPEG; null is empty.

    Also ``n_bytes``, the length before padding. Texts of over 1.5 MB take several images in a
    row, so any length is stored. Equal texts have equal bytes, repeated rows stay, and an empty
    table gives no rows. Other columns may have any names, also those of the results.
    """

    def make():
        def run(texts: pa.Array):
            data = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
            media = encode([padded(t) for t in data])
            return [pa.array([len(t) for t in data], pa.int64()), pa.array(media, pa.binary())]

        return run

    return annotate(df, text_col, make, [("n_bytes", T.LongType()), (name, T.BinaryType())], keep=keep, chunk_bytes=1 << 20)


FEATURES = (
    "width int, height int, images int, components int, thumb_bytes long, thumb_sha256 string, "
    "thumb_tail_crc32 long, average_hash string, media_bytes long, media_sha256 string, error string"
)


def describe(media: list[bytes | None]) -> list[tuple]:
    """FEATURES of each stored form. A column that is no baseline JPEG gives its error and no dimensions."""
    todo: list[tuple[bytes, int]] = []
    owner: list[int] = []
    errors: dict[int, str] = {}
    for i, data in enumerate(media):
        try:
            starts = images_of(data) if data else []
            if not starts:
                raise JpegError("no bytes")
            todo += [(data, s) for s in starts]
            owner += [i] * len(starts)
        except JpegError as e:
            errors[i] = str(e)
    parts: dict[int, list] = {}
    for i, result in zip(owner, thumbnails(todo), strict=True):
        if isinstance(result, JpegError):
            errors.setdefault(i, str(result))
        else:
            parts.setdefault(i, []).append(result)
    out = []
    for i, data in enumerate(media):
        form = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
        if i in errors:
            out.append((None, None, None, None, None, None, None, None, *form, errors[i]))
            continue
        first, thumbs = parts[i][0][0], [t for _, t in parts[i]]
        pixels = b"".join(t.tobytes() for t in thumbs)
        whole = np.concatenate(thumbs) if len({t.shape[1] for t in thumbs}) == 1 else thumbs[0]
        high = sum(image.height for image, _ in parts[i])
        out.append((first.width, high, len(thumbs), len(first.parts), len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-16:]), average_hash(whole), *form, None))
    return out


def features(df: DataFrame, media_col: str = "media", keep=None) -> DataFrame:
    """``df``'s columns ``keep`` and FEATURES of each row's JPEG bytes.

    A null, empty or broken column gives its ``error``, with no dimensions; other rows of its
    batch are not affected. The thumbnail's
    digest is that of its samples, row by row; its tail is the last 16 of them. Equal columns
    have equal features, repeated rows stay, and an empty table gives no rows. Columns are taken
    whole; others may have any names, also those of FEATURES.
    """
    keep = list(df.columns if keep is None else keep)
    inner = df.select(F.col(quoted(media_col)).alias("m"), *[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = [f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]
    schema = ", ".join([*kinds, FEATURES])
    names = [f"k{i}" for i in range(len(keep))] + [f.split()[0] for f in FEATURES.split(", ")]
    types = [pa.int32()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi in slices(lengths(batch.column(0)), CHUNK_BYTES // 2):
                part = batch.slice(lo, hi - lo)
                made = zip(*describe(part.column(0).to_pylist()), strict=True)
                columns = [pa.array(c, kind) for c, kind in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=names)

    return inner.mapInArrow(run, schema).toDF(*keep, *names[len(keep) :])


def op1_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = features(store(docs, keep=["doc_id"]), keep=["doc_id", "n_bytes"])
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "images", "average_hash")
    return found.select(
        "doc_id",
        "n_bytes",
        F.col("thumb_bytes").alias("payload_bytes"),
        F.col("thumb_sha256").alias("payload_sha256"),
        F.col("thumb_tail_crc32").alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
