"""Arrow batches of text as flat byte arrays, cut so that the memory of a task does not depend on the batch size."""

from __future__ import annotations

import builtins
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 1 << 20
PIECE_ROWS = 512


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the ``n + 1`` offsets of the texts in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(ends):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def pieces(batch: pa.RecordBatch, text: str, most_bytes: int = PIECE_BYTES, most_rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Row slices of at most so many rows and bytes of text; a longer text comes alone."""
    _, offsets = flat(batch.column(text))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), start + most_rows, rows)
        yield batch.slice(start, end - start)
        start = end


def append(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], kernel: Callable, **size) -> DataFrame:
    """The columns ``keep`` of ``df`` and the columns that ``kernel(texts)`` computes, without a shuffle."""
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, **size):
                made = kernel(piece.column(text))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + list(made), names=names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def kept(name: str, make: Callable):
    """``make()`` of the first call with this name in this Python worker: vocabularies and what was looked up in them stay
    from task to task. A worker that is lost only starts anew."""
    held = builtins.__dict__.setdefault("_catalog_engine_kept", {})
    if name not in held:
        held[name] = make()
    return held[name]


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))


def sampled(df: DataFrame, key: str, share: float) -> DataFrame:
    """Rows whose hashed key falls into the lowest ``share``: the same rows in every run and on every layout."""
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))
