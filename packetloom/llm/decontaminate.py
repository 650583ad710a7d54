"""Benchmark decontamination: every training passage queries a BM25 index of test items with block-max WAND."""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.columns import whole
from packetloom.llm.packing import small
from packetloom.llm.vectors import fold, word_hashes

# BM25
K1, B = 1.2, 0.75
#: share of an item's own BM25 score that a passage must reach to be retrieved
RETRIEVE = 0.6
#: share of the five-word shingles of question and of answer that a retrieved passage must hold
OVERLAP, SHINGLE = 0.8, 5
#: the last share of an item's words counts as its answer
ANSWER = 0.25
#: items per block of the block-max index
BLOCK = 4
#: words of all items whose index goes to the workers at once; a larger benchmark takes more passes
INDEX_WORDS = 4_000_000

_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_NEVER = 1 << 60


def terms_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``texts``, ASCII punctuation aside, in lower case; and each text's bounds."""
    return word_hashes([t.lower().encode().translate(_PUNCTUATION) for t in texts])


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    if len(words) < size:
        return words[:0]
    return np.unique(fold([words[i : len(words) - size + 1 + i] for i in range(size)]))


@dataclass
class Item:
    id: object
    words: np.ndarray  # hashes, in order
    terms: np.ndarray  # distinct hashes
    impacts: np.ndarray  # BM25 of each term in this item, as shares of their sum

    @property
    def size(self) -> int:
        """Words of a shingle: ``SHINGLE``, or the whole item if it is shorter."""
        return min(SHINGLE, len(self.words))

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the question and of the answer. An item too short to part is both as a whole."""
        n = len(self.words)
        cut = n - max(SHINGLE, round(n * ANSWER))
        if cut < SHINGLE:
            return (_shingles(self.words, self.size),) * 2
        return _shingles(self.words[:cut], SHINGLE), _shingles(self.words[cut:], SHINGLE)


@dataclass
class Index:
    """Postings by term, each with the largest impact of each block of items."""

    items: list[Item]
    terms: np.ndarray = field(init=False)
    block_max: np.ndarray = field(init=False)
    step: int = field(init=False)

    def __post_init__(self) -> None:
        self.terms = np.unique(np.concatenate([i.terms for i in self.items])) if self.items else np.zeros(0, np.uint64)
        blocks = -(-max(1, len(self.items)) // BLOCK)
        # one more row, of zeros, for words that no item has
        self.block_max = np.zeros((len(self.terms) + 1, blocks), np.float32)
        self.posts: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for n, item in enumerate(self.items):
            for t, impact in zip(np.searchsorted(self.terms, item.terms).tolist(), item.impacts.tolist(), strict=True):
                self.posts[t].append((n, impact))
                self.block_max[t, n // BLOCK] = max(self.block_max[t, n // BLOCK], impact)
        # rounding to float32 must not lower a bound
        self.block_max[:-1] *= np.float32(1 + 1e-6)
        self.most = self.block_max.max(1)
        self.step = max([32, *(len(i.words) for i in self.items)])
        self.parts = [i.parts() for i in self.items]

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes; the last row for unknown ones."""
        if not len(self.terms):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, len(self.terms))

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items that the query ``terms`` (distinct, known) score at least ``least``: block-max WAND."""
        lists = [[0, self.posts[t], float(self.most[t]), self.block_max[t]] for t in terms if self.posts[t]]
        found = []

        def item(x: list) -> int:
            return x[1][x[0]][0] if x[0] < len(x[1]) else _NEVER

        def seek(x: list, to: int) -> None:
            while item(x) < to:
                x[0] += 1

        while True:
            lists.sort(key=item)
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                if item(x) == _NEVER:
                    break
                bound += x[2]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            at = item(lists[pivot])
            while pivot + 1 < len(lists) and item(lists[pivot + 1]) == at:
                pivot += 1
            block = at // BLOCK
            if sum(float(x[3][block]) for x in lists[: pivot + 1]) < least:
                # nothing in the rest of this block can do, unless another list joins in
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, item(lists[pivot + 1]))
                for x in lists[: pivot + 1]:
                    seek(x, max(to, at + 1))
            elif item(lists[0]) == at:
                score = sum(x[1][x[0]][1] for x in lists[: pivot + 1])
                if score >= least:
                    found.append((at, score))
                for x in lists[: pivot + 1]:
                    seek(x, at + 1)
            else:
                for x in lists[:pivot]:
                    seek(x, at)

    def matches(self, texts: Sequence[str]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text the items it leaks, with score, question overlap and answer overlap of the best passage.

        Passages are twice as long as the longest item and start every such
        length, so one of them holds any copy of an item. The block bounds of a
        passage's terms are added up for all passages at once; only passages in
        which some block may reach the threshold go through the index.
        """
        words, bounds = terms_of(texts)
        number = self.lookup(words)
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        halves = -(-np.diff(bounds) // self.step)
        first_half = np.concatenate(([0], np.cumsum(halves)))
        known = np.flatnonzero(number < len(self.terms))
        if not len(known):
            return out
        text_of = np.searchsorted(bounds, known, "right") - 1
        inside = (known - bounds[text_of]) // self.step
        size = len(self.terms) + 1
        later = (first_half[text_of] + inside) * size + number[known]
        # each word is in the passage that starts with its half and in the one before; each term of a passage once
        pairs = np.unique(np.concatenate((later, (later - size)[inside > 0])))
        passage, term = pairs // size, pairs % size
        start = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        most = np.zeros(int(first_half[-1]), np.float32)
        for a in range(0, len(start), 4096):  # the gathered rows of a slice only
            rows = slice(start[a], start[a + 4096] if a + 4096 < len(start) else len(passage))
            bound = np.add.reduceat(self.block_max[term[rows]], start[a : a + 4096] - start[a])
            most[passage[start[a : a + 4096]]] = bound.max(1)
        for h in np.flatnonzero(most >= RETRIEVE * (1 - 1e-4)):
            text = int(np.searchsorted(first_half, h, "right") - 1)
            a = int(bounds[text] + (h - first_half[text]) * self.step)
            b = int(min(a + 2 * self.step, bounds[text + 1]))
            query = np.unique(number[a:b])
            found = self.retrieve(query[query < len(self.terms)].tolist(), RETRIEVE)
            if found:
                for n, score in found:
                    held = _shingles(words[a:b], self.items[n].size)
                    question, answer = (float(np.isin(p, held).mean()) for p in self.parts[n])
                    if min(question, answer) >= OVERLAP:
                        out[text][n] = max(out[text].get(n, (0.0, 0.0, 0.0)), (score, question, answer))
        return out


def index_passes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes that together hold all items, each of about ``INDEX_WORDS`` words at most.

    Document frequencies count all items, so results do not depend on the number
    of passes. Items without words, and repeated items, are left out.
    """
    narrow = items.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).distinct()

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows):
            words, bounds = terms_of(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["_id", "words"])

    kind = T.StructType([narrow.schema.fields[0], T.StructField("words", T.ArrayType(T.LongType()))])
    split_items = narrow.mapInArrow(split, kind).where(F.size("words") > 0)
    total, mean, most = split_items.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.sum(F.size("words"))).first()
    if not total:
        return
    passes = -(-most // INDEX_WORDS)
    numbered = split_items.withColumn("_pass", F.pmod(F.xxhash64("_id", "words"), F.lit(passes)))
    frequency = split_items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for p in range(passes):
        own = numbered.where(F.col("_pass") == p)
        used = own.select(F.explode("words").alias("word")).distinct()
        df = {r["word"]: r["df"] for r in frequency.join(used, "word", "left_semi").collect()}  # bounded by INDEX_WORDS
        made = []
        for row in own.orderBy("_id", "words").collect():
            words = np.array(row["words"], np.int64)
            terms, tf = np.unique(words, return_counts=True)
            n = np.array([df[t] for t in terms.tolist()], float)
            weight = np.log1p((total - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            order = np.argsort(terms.view(np.uint64))
            made.append(Item(row["_id"], words.view(np.uint64), terms.view(np.uint64)[order], (weight / weight.sum())[order]))
        yield Index(made)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item it leaks: ids, ``score``, ``question_overlap``, ``answer_overlap``.

    Every passage of every whole text is a query; all items above the threshold
    are retrieved and verified, without a limit. Null text counts as empty;
    repeated documents each give their rows; nothing in, nothing out. No shuffle
    of documents; a benchmark beyond ``INDEX_WORDS`` words takes several passes.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    item_type = items.schema[item_col].dataType
    kind = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(item_col, item_type),
            *[T.StructField(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap")],
        ]
    )
    found = None
    for index in index_passes(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        leaks = narrow.mapInArrow(_leaks(sent, kind.names), kind)
        found = leaks if found is None else found.unionByName(leaks)
    return found if found is not None else docs.sparkSession.createDataFrame([], kind)


def _leaks(sent, names: list[str]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for batch in small(rows):
            hits = _by_slices(index, batch.column(1).to_pylist())
            at = [i for i, h in enumerate(hits) for _ in h]
            items = [n for h in hits for n in h]
            values = [v for h in hits for v in h.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array([index.items[n].id for n in items]) if items else pa.nulls(0, pa.int64()),
                    *[pa.array([v[k] for v in values], pa.float64()) for k in range(3)],
                ],
                names,
            )

    return run


def _by_slices(index: Index, texts: list[str]) -> list[dict[int, tuple[float, float, float]]]:
    """``index.matches`` on some four million characters at a time, to bound memory."""
    out: list[dict[int, tuple[float, float, float]]] = []
    own: list[str] = []
    size = 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= 1 << 22:
            out += index.matches(own)
            own, size = [], 0
    return out + index.matches(own) if own else out


def remove_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; see :func:`find_leaks`. No shuffle."""
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    kept = docs.select(*[F.col(f"`{n}`").alias(i) for n, i in zip(docs.columns, inner, strict=True)], whole(text_col).alias("_in"))
    for index in index_passes(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        kept = kept.mapInArrow(_clean(sent), kept.schema)
    return kept.select(*[F.col(i).alias(n) for n, i in zip(docs.columns, inner, strict=True)])


def _clean(sent):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows):
            hits = _by_slices(sent.value, batch.column(batch.num_columns - 1).to_pylist())
            yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

    return run
