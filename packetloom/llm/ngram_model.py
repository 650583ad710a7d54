"""An interpolated modified Kneser-Ney bigram model: counted by Spark, kept as sorted hash arrays, memory-mapped by workers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.storage import scratch_path
from packetloom.llm.columns import whole
from packetloom.llm.packing import small
from packetloom.llm.vectors import mix, word_hashes

#: hash of the end token; no word has it, as words come out of ``mix`` with their length
END = np.uint64(0x9DDFEA08EB382D69)
_SLICE = 1 << 22
_WORD_STATS = ("followers1", "followers2", "followers3", "before")


def local_folder(path: str) -> str:
    """The path of a mounted folder; memory-mapping needs one."""
    plain = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"the model's arrays are memory-mapped, so {path} must be a mounted shared folder")
    return plain


def _slices(texts: Sequence[str]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of texts of some four megabytes."""
    own, size, first = [], 0, 0
    for i, text in enumerate(texts):
        own.append(text.encode())
        size += len(own[-1])
        if size >= _SLICE:
            yield first, i + 1, own
            own, size, first = [], 0, i + 1
    if own:
        yield first, len(texts), own


def tokens(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words followed by ``END``, and the texts' bounds."""
    words, bounds = word_hashes(texts)
    ends = bounds + np.arange(len(bounds))
    out = np.empty(len(words) + len(texts), np.uint64)
    last = np.zeros(len(out), bool)
    last[ends[1:] - 1] = True
    out[last] = END
    out[~last] = words
    return out, ends


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of unsigned hashes: equal stretches of their range, in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, so a task that runs again does no harm."""
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        np.save(f, array)
    os.replace(temporary, f"{folder}/{name}.npy")


def _narrow(array: np.ndarray) -> np.ndarray:
    """In the smallest type that holds the largest number."""
    return array.astype(np.min_scalar_type(int(array.max(initial=0))))


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all words share."""

    folder: str
    shards: int
    offsets: np.ndarray  # id of the first word of each shard
    tokens: int
    words: int
    documents: int
    types: int = 0
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_rest: float = 1.0
    start_stats: np.ndarray | None = None  # numbers of first words seen once, twice, more often

    @property
    def spread(self) -> int:
        """A context seen more often has its bigrams dealt over all shards, else they share one."""
        return max(1000, self.tokens // (4 * self.shards))

    @property
    def start(self) -> int:
        """The id of the beginning of a text, after those of all words."""
        return self.words


class Arrays:
    """The model's arrays as one worker sees them; only pages that are looked up are read."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.maps: dict[str, np.ndarray] = {}

    def array(self, name: str) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = np.load(f"{self.model.folder}/{name}.npy", mmap_mode="r")
        return self.maps[name]

    def _find(self, kind: str, shards: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """For keys sorted by shard and value: where each stretch's hits are among the keys and in the shard's arrays."""
        edges = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True]))) if len(shards) else np.zeros(0, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            shard = str(shards[a])
            stored = self.array(f"{kind}-{shard}")
            if len(stored):
                at = np.minimum(np.searchsorted(stored, keys[a:b]), len(stored) - 1)
                hit = np.flatnonzero(stored[at] == keys[a:b])
                yield a + hit, shard, at[hit]

    def words(self, hashes: np.ndarray, stats: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown), counts and statistics of sorted distinct word hashes."""
        ids = np.full(len(hashes), -1, np.int64)
        counts = np.zeros(len(hashes), np.int64)
        numbers = np.zeros((len(_WORD_STATS), len(hashes)), np.int64)
        for hit, shard, at in self._find("words", shard_of(hashes, self.model.shards), hashes):
            ids[hit] = self.model.offsets[int(shard)] + at
            counts[hit] = self.array(f"counts-{shard}")[at]
            if stats:
                numbers[:, hit] = self.array(f"stats-{shard}")[:, at]
        return ids, counts, numbers

    def bigrams(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Counts of bigram keys in any order."""
        order = np.lexsort((keys, shards))
        found = np.zeros(len(keys), np.int64)
        for hit, shard, at in self._find("bigrams", shards[order], keys[order]):
            found[order[hit]] = self.array(f"times-{shard}")[at]
        return found


def _keys(model: Model, before: np.ndarray, count_before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each pair of ids, one-to-one, and its shard."""
    keys = mix(before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))
    by = np.where(count_before > model.spread, keys, mix(before.astype(np.uint64) + np.uint64(1)))
    return keys, shard_of(by, model.shards)


def _unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""

    def unshift(x: np.ndarray, n: int) -> np.ndarray:
        y = x
        for _ in range(64 // n):
            y = x ^ (y >> np.uint64(n))
        return y

    x = unshift(h, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    x = unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return unshift(x, 30)


def _discounts(of: Sequence[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of types seen once, twice, three and four times."""
    n1, n2, n3, n4 = map(float, of)
    if not n1 or not n2:
        return (0.5, 0.75, 0.9)  # too few types to estimate from
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (0.95, 1.95, 2.95), strict=True))


def _gathered(rows: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray]:
    batches = [b for b in rows if b.num_rows]
    return [np.concatenate([b.column(i).to_numpy() for b in batches] or [np.zeros(0, np.int64)]) for i in range(columns)]


def _ends(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count ``docs`` and write the arrays to the shared folder.

    Two passes over the texts: one counts words, one counts bigrams. Each task
    sums equal keys before they are shuffled to the shard that sorts and stores
    them; shards grow in number with ``spark.sql.shuffle.partitions``. Bigrams of
    a very frequent context are spread over all shards. Nothing but a few numbers
    per shard comes to the driver. A vocabulary of 2^32 words or more is refused.
    An empty table gives a model in which every word is unknown.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = local_folder(scratch_path(spark, "ngrams"))
    os.makedirs(folder)
    texts = docs.select(whole(text_col).alias("_text"))

    def count_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, _, own in _slices(batch.column(0).to_pylist()):
                words, n = np.unique(tokens(own)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard_of(words, shards)), pa.array(words.view(np.int64)), pa.array(n)], ["shard", "word", "n"]
                )

    def store_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, word, n = _gathered(rows, 3)
        found = []
        for s in np.unique(shard).tolist():
            own = shard == s
            words, at = np.unique(word[own].view(np.uint64), return_inverse=True)
            counts = np.bincount(at, n[own], len(words)).astype(np.int64)
            _save(folder, f"words-{s}", words)
            _save(folder, f"counts-{s}", _narrow(counts))
            ends = counts[words == END]
            found.append((s, len(words), int(counts.sum()), int(ends.sum())))
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "words", "tokens", "ends"), f, strict=True)) for f in found], _SHARD)

    _SHARD = pa.schema([(c, pa.int64()) for c in ("shard", "words", "tokens", "ends")])
    counted = texts.mapInArrow(count_words, "shard long, word long, n long").repartition(shards, "shard")
    stored = counted.mapInArrow(store_words, "shard long, words long, tokens long, ends long").collect()
    sizes = np.zeros(shards, np.int64)
    for row in stored:
        sizes[row["shard"]] = row["words"]
    for s in np.flatnonzero(sizes == 0).tolist():
        _save(folder, f"words-{s}", np.zeros(0, np.uint64))
        _save(folder, f"counts-{s}", np.zeros(0, np.int64))
    total = int(sizes.sum())
    if total >= 2**32 - 1:
        raise ValueError("more than 2^32 distinct words")
    model = Model(
        folder, shards, np.concatenate(([0], np.cumsum(sizes)[:-1])), sum(r["tokens"] for r in stored), total, sum(r["ends"] for r in stored)
    )
    return _fit_bigrams(spark, texts, model)


def _fit_bigrams(spark: SparkSession, texts: DataFrame, model: Model) -> Model:
    folder, shards = model.folder, model.shards

    def count_bigrams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for batch in rows:
            for _, _, own in _slices(batch.column(0).to_pylist()):
                before, count_before, ids, _, _, _ = _pairs(arrays, own, stats=False)
                keys, shard = _keys(model, before, count_before, ids)
                keys, first, n = np.unique(keys, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[first]), pa.array(keys.view(np.int64)), pa.array(n)], ["shard", "bigram", "n"]
                )

    def store_bigrams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key, n = _gathered(rows, 3)
        for s in np.unique(shard).tolist():
            own = shard == s
            order = np.argsort(key[own].view(np.uint64))
            keys, times = key[own].view(np.uint64)[order], n[own][order]
            first = _ends(keys)
            keys, times = keys[first], np.add.reduceat(times, first)
            _save(folder, f"bigrams-{s}", keys)
            _save(folder, f"times-{s}", _narrow(times))
            pair = _unmix(keys)
            before, word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            seen, at = np.unique(before, return_inverse=True)
            ones, twos = (np.bincount(at, times == k, len(seen)).astype(np.int64) for k in (1, 2))
            more = np.bincount(at, minlength=len(seen)) - ones - twos
            yield _stats(seen, ones, twos, more, np.zeros_like(seen))
            seen, types = np.unique(word, return_counts=True)
            yield _stats(seen, *[np.zeros_like(seen)] * 3, types)
            # numbers of bigrams seen once to four times, under ids below all others
            counts = np.bincount(np.minimum(times, 5), minlength=6)[1:5]
            yield _stats(np.arange(-4, 0), *[np.zeros(4, np.int64)] * 3, counts[::-1])

    def _stats(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", *_WORD_STATS])

    def store_stats(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _gathered(rows, 6)
        shard, ids, numbers = columns[0], columns[1], columns[2:]
        ends = np.append(model.offsets[1:], model.words)
        of = np.zeros(5, np.int64)
        for s in np.unique(shard).tolist():
            own = shard == s
            table = np.zeros((len(_WORD_STATS), int(ends[s] - model.offsets[s])), np.int64)
            for line, number in zip(table, numbers, strict=True):
                line[ids[own] - model.offsets[s]] = number[own]
            _save(folder, f"stats-{s}", _narrow(table))
            of += np.bincount(np.minimum(table[3], 5), minlength=6)[1:]
        yield pa.RecordBatch.from_arrays([pa.array([*range(1, 6), 0]), pa.array([*of.tolist(), 0])], ["k", "n"])

    columns = ", ".join(f"{c} long" for c in _WORD_STATS)
    counted = texts.mapInArrow(count_bigrams, "shard long, bigram long, n long").repartition(shards, "shard")
    summed = (
        counted.mapInArrow(store_bigrams, f"id long, {columns}").groupBy("id").agg(*[F.sum(c).alias(c) for c in _WORD_STATS])
    )
    path = scratch_path(spark, "ngram-stats")
    summed.write.parquet(path)
    summed = spark.read.parquet(path)
    of = {r["id"]: r["before"] for r in summed.where("id < 0").collect()}
    model.discounts = _discounts([of.get(-k, 0) for k in range(1, 5)])
    edges = F.array(*[F.lit(int(x)) for x in model.offsets])
    # the last shard that starts at or before the id; empty shards share their start with the next one
    placed = summed.where((F.col("id") >= 0) & (F.col("id") < model.words)).select(
        (F.size(F.filter(edges, lambda e: e <= F.col("id"))) - 1).cast("long").alias("shard"), "id", *_WORD_STATS
    )
    classes = placed.repartition(shards, "shard").mapInArrow(store_stats, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    for s in range(shards):
        if not os.path.exists(f"{folder}/stats-{s}.npy"):
            size = int(np.append(model.offsets[1:], model.words)[s] - model.offsets[s])
            _save(folder, f"stats-{s}", np.zeros((len(_WORD_STATS), size), np.int64))
        if not os.path.exists(f"{folder}/bigrams-{s}.npy"):
            _save(folder, f"bigrams-{s}", np.zeros(0, np.uint64))
            _save(folder, f"times-{s}", np.zeros(0, np.uint32))
    n = {r["k"]: r["n"] for r in classes}
    start = summed.where(F.col("id") == model.start).collect()
    model.types = sum(r["n"] for r in summed.agg(F.sum("before").alias("n")).collect() if r["n"]) - sum(of.values())
    model.low_discounts = _discounts([n.get(k, 0) for k in range(1, 5)])
    d1, d2, d3 = model.low_discounts
    if model.types:
        model.low_rest = (d1 * n.get(1, 0) + d2 * n.get(2, 0) + d3 * (n.get(3, 0) + n.get(4, 0) + n.get(5, 0))) / model.types
    model.start_stats = np.array([start[0][c] for c in _WORD_STATS[:3]] if start else [0, 0, 0], np.int64)
    return model


def _pairs(arrays: Arrays, texts: list[bytes], stats: bool = True):
    """Of every token: the id and count of the one before, its own id and count, and statistics of both."""
    model = arrays.model
    hashes, ends = tokens(texts)
    distinct, at = np.unique(hashes, return_inverse=True)
    ids, counts, numbers = arrays.words(distinct, stats)
    ids, counts = ids[at], counts[at]
    before, count_before = np.roll(ids, 1), np.roll(counts, 1)
    first = ends[:-1]
    before[first], count_before[first] = model.start, model.documents
    return before, count_before, ids, counts, numbers[:, at] if stats else numbers, ends


def _score(arrays: Arrays, texts: list[bytes]) -> dict[str, np.ndarray]:
    model = arrays.model
    before, count_before, ids, counts, numbers, ends = _pairs(arrays, texts)
    first = ends[:-1]
    types = numbers[3]
    low = np.maximum(types - _discount(types, model.low_discounts), 0) / max(model.types, 1)
    low = low + model.low_rest / (model.words + 1)
    follow = np.roll(numbers[:3], 1, axis=1)
    follow[:, first] = model.start_stats[:, None]
    seen = (before >= 0) & (ids >= 0) & (count_before > 0)
    keys, shard = _keys(model, before[seen], count_before[seen], ids[seen])
    distinct, one, at = np.unique(keys, return_index=True, return_inverse=True)
    times = np.zeros(len(ids), np.int64)
    times[seen] = arrays.bigrams(distinct, shard[one])[at]
    total = np.maximum(count_before, 1)
    rest = sum(d * f for d, f in zip(model.discounts, follow, strict=True)) / total
    high = np.maximum(times - _discount(times, model.discounts), 0) / total
    p = np.where((before >= 0) & (count_before > 0), high + rest * low, low)
    base = np.log10((counts + 1) / (model.tokens + model.words + 1))
    return {
        "n_tokens": np.diff(ends),
        "n_known": np.add.reduceat((counts > 0).astype(np.int64), first),
        "base_score": np.add.reduceat(base, first),
        "score": np.add.reduceat(np.log10(p), first),
    }


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens n_known base_score score perplexity`` of each whole text; equal input names give way.

    ``score`` is the model's log10 probability of the text's words and its end,
    ``perplexity`` that per token. An unknown word has the probability of one
    unseen word. Null text is the empty text, which has an end only. No shuffle.
    """
    added = {"n_tokens": T.LongType(), "n_known": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    names = [c for c in df.columns if c.lower() not in {*added, "perplexity"}]
    inner = [f"_c{i}" for i in range(len(names))]
    narrow = df.select(*[F.col(f"`{n}`").alias(i) for n, i in zip(names, inner, strict=True)], whole(text_col).alias("_in"))
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few numbers per shard

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(sent.value)
        for batch in small(rows):
            for a, b, own in _slices(batch.column(len(inner)).to_pylist()):
                scored = _score(arrays, own)
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(scored[c]) for c in added]], [*inner, *added])

    schema = T.StructType([*narrow.schema.fields[:-1], *[T.StructField(c, t) for c, t in added.items()]])
    return narrow.mapInArrow(run, schema).select(
        *[F.col(i).alias(n) for n, i in zip(names, inner, strict=True)],
        *added,
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
