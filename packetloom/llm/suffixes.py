"""Suffix-array deduplication of byte strings that occur more than once, across all documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.storage import scratch_path
from packetloom.llm.columns import whole
from packetloom.llm.packing import pack, small
from packetloom.llm.vectors import mix

#: bytes of a string that counts as repeated
LENGTH = 200
_GRAM = 32
_GRAMS = LENGTH - _GRAM + 1
#: different contexts of one key that one suffix array takes; more are cut into narrower ones
MOST = 256
#: starts of a context, level by level; at one start a context is the string itself
_WIDTHS = (_GRAMS, 85, 17, 1)
_PIECE = 1 << 20

_BYTE = np.random.default_rng(20240602).integers(0, 2**64, 256, np.uint64)
_BASE = 0x5851F42D4C957F2D
_RUNS = "array<struct<lo: long, hi: long>>"


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.cumprod(x)

    return row(_BASE), row(pow(_BASE, -1, 2**64))


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` values in a row, the leftmost among equals."""
    n = len(values)
    packed = (values & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)  # n is below 2^24
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = packed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(back[:count], ahead[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Where strings of ``LENGTH`` bytes meet equal ones: (anchor, hash, first start, last start, context hash).

    The anchor of a string is its leftmost gram of the smallest hash, which only
    its bytes decide; equal strings have equal anchors at equal places. Starts
    with the same anchor are neighbours; they make up its context, the bytes from
    the first of these strings to the end of the last. Long texts go in pieces.
    """
    for at in range(0, max(1, len(raw) - LENGTH + 1), _PIECE):
        # the strings that start in the piece; a context may end at its border, which costs only bytes
        own = np.frombuffer(raw[at : at + _PIECE + LENGTH - 1], np.uint8)
        if len(own) < LENGTH:
            return
        power, inverse = _powers(_PIECE + LENGTH if len(own) > 1 << 14 else (1 << 14) + 1)
        summed = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTE[own] * power[: len(own)], out=summed[1:])
        grams = mix((summed[_GRAM:] - summed[:-_GRAM]) * inverse[: len(own) - _GRAM + 1])
        chosen = _leftmost_minima(grams, _GRAMS)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.append(first[1:], len(chosen)) - 1
        anchor = chosen[first]
        context = mix((summed[last + LENGTH] - summed[first]) * inverse[first])
        context = mix(context + (anchor - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64))
        yield anchor + at, grams[anchor], first + at, last + at, context


def suffix_order(text: bytes) -> list[int]:
    """All suffixes of ``text`` in order of their first ``LENGTH`` bytes at least, by two-stage sorting.

    Only suffixes smaller than their successor are sorted directly. A scan over
    the buckets of first bytes then places each other one: it follows its
    successor, which is smaller and so already in place.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if not n:
        return []
    where = np.append(np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1), n - 1)
    turn = np.minimum.accumulate(where[::-1])[::-1]  # the next place where a byte differs from the one after
    smaller = (turn < n - 1) & (t[turn] < t[np.minimum(turn + 1, n - 1)])
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: text[i : i + LENGTH])
    counts = np.bincount(t, minlength=256)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    order = [-1] * n
    # within a first byte the directly sorted ones come last
    at = (starts + counts - np.bincount(t[smaller], minlength=256)).tolist()
    for i in direct:
        order[at[text[i]]] = i
        at[text[i]] += 1
    head = starts.tolist()
    larger = (~smaller).tolist()
    # the empty suffix comes before all others
    order[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    for k in range(n):
        i = order[k] - 1
        if i >= 0 and larger[i]:
            order[head[text[i]]] = i
            head[text[i]] += 1
    return order


def repeated_starts(contexts: list[tuple[bytes, int]]) -> list[list[int]]:
    """For each context (bytes, how often it occurs) the starts of strings that occur more than once.

    Equal strings are neighbours in the suffix array of all contexts, with a
    common prefix of ``LENGTH`` bytes or more. Suffixes that run into the next
    context are no strings of any document and are passed over.
    """
    text = b"".join(c for c, _ in contexts)
    begin = np.concatenate(([0], np.cumsum([len(c) for c, _ in contexts])))
    at = np.arange(len(text))
    owner = np.searchsorted(begin, at, "right") - 1
    valid = (at + LENGTH <= begin[owner + 1]).tolist()
    out: list[list[int]] = [[] for _ in contexts]
    run: list[int] = []
    before = b""

    def close() -> None:
        if len(run) > 1 or (run and contexts[owner[run[0]]][1] > 1):
            for i in run:
                out[owner[i]].append(int(i - begin[owner[i]]))

    for i in suffix_order(text):
        if valid[i]:
            string = text[i : i + LENGTH]
            if string != before:
                close()
                run, before = [], string
            run.append(i)
    close()
    return out


def _runs(starts: list[int], shift: int) -> list[dict]:
    if not starts:
        return []
    s = np.unique(starts)
    first = np.flatnonzero(np.concatenate(([True], np.diff(s) > 1)))
    last = np.append(first[1:], len(s)) - 1
    return [{"lo": int(a) + shift, "hi": int(b) + shift} for a, b in zip(s[first], s[last], strict=True)]


def _united(runs: str) -> Column:
    """Sorted runs with those that overlap or touch as one."""

    def add(done: Column, run: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last.lo.alias("lo"), F.greatest(last.hi, run.hi).alias("hi"))
        touches = (F.size(done) > 0) & (last.hi + 1 >= run.lo)
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.array().cast(_RUNS), add)


_RUN_ARROW = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """``key, context, runs`` of contexts that share their key with few others, bucket after bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def solve(out: list) -> None:
            found = repeated_starts([(bytes_, times) for _, _, bytes_, times in held])
            out += [(key, c, _runs(s, shift)) for (c, shift, _, _), s in zip(held, found, strict=True)]

        for batch in small(batches):
            out: list = []
            for k, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and held:
                    solve(out)
                    held = []
                key = k
                held.append(rest)
            yield _triples(out)
        out = []
        if held:
            solve(out)
        yield _triples(out)

    by_key = rows.repartition("key").sortWithinPartitions("key", "context").select("key", "context", "shift", "bytes", "times")
    return by_key.mapInArrow(run, f"key long, context long, runs {_RUNS}")


def _triples(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], _RUN_ARROW)],
        ["key", "context", "runs"],
    )


def _narrower(rows: DataFrame, width: int) -> DataFrame:
    """Cut contexts into ones of ``width`` starts, keyed by the bytes that all their strings share.

    Cuts fall at fixed places from the anchor, so equal strings stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for a, c, key, shift, data, times in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                last = shift + len(data) - LENGTH
                for block in range((shift + _GRAMS) // width, (last + _GRAMS) // width + 1):
                    low = block * width - _GRAMS  # the block's first and last start, from the anchor
                    high = low + width - 1
                    i, j = max(low, shift), min(high, last)
                    piece = data[i - shift : j - shift + LENGTH]
                    core = data[high - shift : low - shift + LENGTH] if low >= shift else data[max(0, high - shift) : low - shift + LENGTH]
                    row = (a, c, _hash(key.to_bytes(8, "little", signed=True) + block.to_bytes(2, "little") + core), _hash((i - low).to_bytes(2, "little") + piece), i, piece, times)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [*[pa.int64()] * 5, pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, types, strict=True)], ["anchor_key", "anchor_context", "key", "context", "shift", "bytes", "times"]
            )

    return rows.select("anchor_key", "anchor_context", "key", "shift", "bytes", "times").mapInArrow(
        run, "anchor_key long, anchor_context long, key long, context long, shift long, bytes binary, times long"
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _mark, lo, hi``: in each document runs of starts of strings that occur elsewhere too.

    1. Every string has an anchor (:func:`anchors`), about one for 85 bytes.
       Anchors that occur once go no further.
    2. Where all contexts of an anchor are equal, all their strings are repeated.
    3. Else one example of each different context, with its number of copies,
       goes to the task of its anchor, which sorts their suffixes.
    4. An anchor with more than ``MOST`` different contexts is first cut into
       contexts of fewer starts, keyed by the bytes they share, down to single strings.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, text in enumerate(batch.column(2).to_pylist()):
                for part in anchors(text.encode()):
                    for column, values in zip(found, (np.full(len(part[0]), i), *part), strict=True):
                        column.append(values)
            row, anchor, key, first, last, context = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row),
                    batch.column(1).take(row),
                    pa.array(key.view(np.int64)),
                    pa.array(context.view(np.int64)),
                    *[pa.array(x.astype(np.int32)) for x in (anchor, first, last)],
                ],
                ["_id", "_mark", "key", "context", "anchor", "first", "last"],
            )

    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(whole(text_col)).alias("_mark"), whole(text_col).alias("_text"))
    places = stored(
        texts.mapInArrow(find, "_id long, _mark long, key long, context long, anchor int, first int, last int"), "anchors"
    )
    # written, so that the join below may split a key of many places
    again = stored(
        places.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"))
        .where("n > 1")
        .select("key", (F.col("c0") < F.col("c1")).alias("mixed")),
        "keys",
    )
    places = stored(places.join(again, "key"), "repeated")
    alike = places.where("not mixed").select("_id", "_mark", F.col("first").cast("long").alias("lo"), F.col("last").cast("long").alias("hi"))

    examples = places.where("mixed").groupBy("key", "context").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("_id", "_mark", "anchor", "first", "last")).alias("at")
    )
    wanted = examples.select(
        F.col("at._id").alias("_id"), F.col("at._mark").alias("_mark"), F.struct("key", "context", "times", "at.anchor", "at.first", "at.last").alias("want")
    )
    wanted = wanted.groupBy("_id", "_mark").agg(F.collect_list("want").alias("wants"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            out: list[tuple] = []
            for packed, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = unpack(packed)
                for w in wants:
                    out.append((w["key"], w["context"], w["first"] - w["anchor"], raw[w["first"] : w["last"] + LENGTH], w["times"]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["key", "context", "shift", "bytes", "times"]
            )

    joined = pack(texts, "_text").dropDuplicates(["_id", "_mark"]).join(wanted, ["_id", "_mark"]).select("_text", "wants")
    contexts = stored(joined.mapInArrow(extract, "key long, context long, shift long, bytes binary, times long"), "contexts")
    level = contexts.withColumns({"anchor_key": F.col("key"), "anchor_context": F.col("context")})
    solved = None
    for width in _WIDTHS:
        if width < _GRAMS:
            level = stored(_narrower(level, width), "narrower")
        one = level.groupBy("key", "context").agg(F.sum("times").alias("times"), F.min("shift").alias("shift"), F.min("bytes").alias("bytes"))
        kinds = level.select("key", "context").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
        counted = one.join(kinds, "key")
        runs = F.array(F.struct(F.col("shift").alias("lo"), (F.col("shift") + F.octet_length("bytes") - LENGTH).alias("hi")))
        alone = counted.where("kinds = 1 and times > 1").select("key", "context", runs.cast(_RUNS).alias("runs"))
        found = alone.unionByName(_sorted_runs(counted.where((F.col("kinds") > 1) & (F.col("kinds") <= MOST))))
        found = stored(level.select("anchor_key", "anchor_context", "key", "context").join(found, ["key", "context"]).select(
            "anchor_key", "anchor_context", F.explode("runs").alias("run")
        ), "runs")
        solved = found if solved is None else solved.unionByName(found)
        level = level.join(kinds.where(F.col("kinds") > MOST).select("key"), "key", "left_semi")
        if width == 1 or level.isEmpty():
            break
    # one row for a context, whose starts are at most _GRAMS, so a place meets one row
    solved = solved.groupBy("anchor_key", "anchor_context").agg(F.sort_array(F.collect_set("run")).alias("runs"))
    solved = stored(solved.withColumn("runs", _united("runs")), "runs")
    mixed = (
        places.where("mixed")
        .select("_id", "_mark", F.col("key").alias("anchor_key"), F.col("context").alias("anchor_context"), "anchor")
        .join(solved, ["anchor_key", "anchor_context"])
        .select("_id", "_mark", "anchor", F.explode("runs").alias("run"))
        .select("_id", "_mark", (F.col("anchor") + F.col("run.lo")).alias("lo"), (F.col("anchor") + F.col("run.hi")).alias("hi"))
    )
    return alike.unionByName(mixed)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte of a 200-byte string that also starts anywhere else, the same document included.

    Returns per row ``id_col, n_bytes, n_removed, n_spans`` (maximal removed
    runs), ``kept`` (the remaining bytes) and ``kept_sha256``. Null text is
    empty; texts under 200 bytes lose nothing; a repeated row repeats all its
    strings; rows without an id count too and keep a null id.
    """
    spans = repeated_spans(docs, id_col, text_col)
    by_doc = spans.groupBy("_id", "_mark").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(whole(text_col)).alias("_mark"), whole(text_col).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in small(batches):
            out: list[tuple] = []
            for own, packed, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack(packed)
                kept, at, removed, runs = [], 0, 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    hi += LENGTH
                    if lo > at or not runs:
                        kept.append(raw[at:lo])
                        runs += 1
                        removed += hi - lo
                        at = hi
                    elif hi > at:
                        removed += hi - at
                        at = hi
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((None if own == -(2**63) else own, len(raw), removed, runs, rest, hashlib.sha256(rest).hexdigest()))
            types = [*[pa.int64()] * 4, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    return (
        pack(texts, "_text")
        .join(by_doc, ["_id", "_mark"], "left")
        .select("_id", "_text", "spans")
        .mapInArrow(cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    )
