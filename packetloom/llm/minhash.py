"""Order MinHash: fingerprints of texts that notice changes of order, so likeness follows edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.columns import whole
from packetloom.llm.packing import pack, small
from packetloom.llm.vectors import fold, mix

K, TUPLE, CELLS = 8, 2, 64
# ranges of the table in order of ids, at most; each streams through one task, however long
MAX_RANGES = 4096
_POS_BITS = 20
_POS = np.uint64((1 << _POS_BITS) - 1)
# k-mers of a text up to which positions fit into the low bits; longer texts give the same numbers by another sort
LONG = int(_POS)
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _kmers(points: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``K`` code points, by doubling; a shorter text is one run."""
    h = points.astype(np.uint64)
    if len(h) < K:
        return mix(np.array([int.from_bytes(hashlib.blake2b(points.tobytes(), digest_size=8).digest(), "little")], np.uint64))
    h = mix(h + np.uint64(1))
    for step, odd in zip((1, 2, 4), _ODD, strict=True):
        h = h[:-step] * odd + h[step:]
    return mix(h)


def signature(text: str) -> np.ndarray:
    """``CELLS`` numbers of 16 bits; 0 marks a cell without k-mers.

    Each k-mer is numbered by occurrence, and the pair hashed. The hash deals the
    numbered k-mers to the cells; in each cell the ``TUPLE`` smallest are taken
    back into text order and hashed together. One hash serves all cells, so the
    work is two sorts of the text's k-mers, whatever the number of cells.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(CELLS, np.uint16)
    h = _kmers(points)
    at = np.arange(len(h), dtype=np.uint64)
    if len(h) <= LONG:
        packed = np.sort((h & ~_POS) | at)  # 44 bits of hash, then the position
        pos, h = packed & _POS, packed & ~_POS
    else:
        h = h & ~_POS  # the same bits as above; a longer position does not fit beside them
        pos = np.argsort(h, kind="stable").astype(np.uint64)
        h = h[pos]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    g = mix(h + occurrence * _ODD[0])
    if len(h) <= LONG:
        packed = np.sort((g & ~_POS) | pos)
        pos, g = packed & _POS, packed & ~_POS
    else:
        g = g & ~_POS
        order = np.lexsort((pos, g))
        pos, g = pos[order], g[order]
    edge = np.searchsorted(g >> np.uint64(58), np.arange(CELLS + 1, dtype=np.uint64))
    index = edge[:-1, None] + np.arange(TUPLE)
    there = index < edge[1:, None]
    index = np.where(there, index, 0)
    far = np.uint64(2**63)
    where = np.where(there, pos[index], far)
    back = np.argsort(where, axis=1)
    chosen = np.where(there, g[index] | np.uint64(1), np.uint64(0))
    chosen = np.take_along_axis(chosen, back, 1)
    made = fold([chosen[:, i] for i in range(TUPLE)])
    return np.where(there[:, 0], made % np.uint64(0xFFFF) + np.uint64(1), np.uint64(0)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of cells, of those either text uses, that are equal; 1 for two empty texts."""
    used = (a != 0) | (b != 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


def _hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each whole text (null: empty) in hexadecimal; no shuffle."""
    names = [c for c in df.columns if c.lower() != out.lower()]
    inner = [f"_c{i}" for i in range(len(names))]
    narrow = df.select(*[F.col(f"`{n}`").alias(i) for n, i in zip(names, inner, strict=True)], whole(text_col).alias("_in"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows):
            made = pa.array([_hex(signature(t)) for t in batch.column(len(inner)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*inner, "_out"])

    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("_out", T.StringType())])
    return narrow.mapInArrow(run, schema).select(
        *[F.col(i).alias(n) for n, i in zip(names, inner, strict=True)], F.col("_out").alias(out)
    )


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_following(df: DataFrame, rows_per_range: int, id_col: str, text_col: str) -> DataFrame:
    """``_range, _kind, _id, _text`` such that each row's following row is the next of its range.

    Rows follow each other by falling id (rows without one last; equal ids by
    falling text), the last one is followed by the first. Ranges hold about
    ``rows_per_range`` rows, cut at approximate quantiles of the ids. Where a
    range ends, a copy (kind 1) of the first row of the next non-empty range
    stands behind its last row. The texts are shuffled once, and no window goes
    over the whole table: only one row per range is compared.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = df.select(order.alias("_order"), F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    ranges = min(MAX_RANGES, -(-rows.count() // rows_per_range))
    cuts: list[int] = []
    if ranges > 1:
        found = rows.agg(F.percentile_approx("_order", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c"))
        cuts = sorted(set(found.first()["c"]))
    # the number of cuts at or above an id: ranges in falling order of ids
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    placed = rows.withColumn("_range", F.size(F.filter(bounds, lambda c: c > F.col("_order"))))
    heads = placed.groupBy("_range").agg(F.max("_order").alias("_order"))
    firsts = [(r["_range"], r["_order"]) for r in heads.orderBy("_range").collect()]  # one pair of numbers per range
    if not firsts:
        return placed.select("_range", F.lit(0).alias("_kind"), "_order", "_tie", "_id", "_text")
    before = {order: firsts[i - 1][0] for i, (_, order) in enumerate(firsts)}
    at = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_order"))
    head = (
        placed.where(F.col("_order").isin([*before]))
        .groupBy("_order")
        .agg(F.max_by("_text", "_tie").alias("_text"))
        .select(at.alias("_range"), F.lit(1).alias("_kind"), F.lit(-(2**63)).alias("_order"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(df.schema[id_col].dataType).alias("_id"), "_text")
    )
    return placed.select("_range", F.lit(0).alias("_kind"), "_order", "_tie", "_id", "_text").unionByName(head)


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2000) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the following text's are.

    See :func:`edited` and :func:`with_following`. One row per row of ``df``;
    an only row is followed by itself. Rows stream through each task in order, so
    memory is that of a batch and one text.
    """
    rows = with_following(df, rows_per_range, id_col, text_col)
    id_type = df.schema[id_col].dataType
    n = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    sorted_rows = pack(rows, "_text").repartition(_partitions(rows, n), "_range").sortWithinPartitions(
        "_range", "_kind", F.desc("_order"), F.desc("_tie")
    )
    out = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, with its signature, waiting for its following text
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            columns: list[list] = [[] for _ in out.fields]
            for kind, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unpack(text).decode()
                made = signature(text)
                if last is not None:
                    before, was, sign = last
                    new = edited(was, text)
                    changed = signature(new)
                    row = (before, len(was), hashlib.sha256(new.encode()).hexdigest(), _hex(sign), _hex(changed))
                    row += (likeness(sign, changed), likeness(sign, made))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                last = (own, text, made) if kind == 0 else None  # a copy ends its range
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], out.names)

    types = [_id_arrow(id_type), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return sorted_rows.select("_kind", "_id", "_text").mapInArrow(run, out)


def _partitions(rows: DataFrame, least: int) -> int:
    return max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _id_arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[kind]


