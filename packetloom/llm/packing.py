"""Batches cut small for Python, and texts compressed for a shuffle, which its block codec leaves large."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROWS = 256


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at a time: what a worker builds from a batch stays small, however Spark cuts them."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def pack(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the (not null) text as zstandard-compressed UTF-8."""
    others = [c for c in df.columns if c != text_col]
    kind = T.StructType([*[df.schema[c] for c in others], T.StructField(text_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in small(batches):
            packed = pa.array([compress(t.encode()) for t in batch.column(len(others)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], kind.names)

    return df.select(*[F.col(f"`{c}`") for c in others], F.col(text_col)).mapInArrow(run, kind)
