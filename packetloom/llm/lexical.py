"""Ranked lexical search: every document against every item by exact integer scores.

A score is a product of two tables: how often an item says a term, and what the
term adds in a document (its impact). Both are cut into tiles that are dense
enough for BLAS: some items with the compact vocabulary of just these items on one
side, some documents on the other. All entries are whole numbers, and a tile is
made so that no partial sum can reach 2**53, so products in float64 are exact
whatever order BLAS adds in; sums over tiles are 64-bit integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.storage import cut_lineage, scratch_path
from packetloom.llm.columns import whole
from packetloom.llm.packing import small
from packetloom.llm.topk import Top, best_rows

# on UTF-8: ASCII letters and digits, and every byte of a longer character
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_PIECE = 1 << 20  # bytes of a text that are split at a time

# fixed values of the score
WEIGHT, IMPACT, TF, LENGTH = 1000, 1_000_000_000, 1000, 12
EXACT = 1 << 53

TILE_TERMS = 1024  # vocabulary of a tile
TILE_ITEMS = 1024
TILE_DOCS = 256
# items, and pairs of an item and its term, that one pass over the documents should answer
PASS_ITEMS = 10_000
PASS_TERMS = 250_000


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8 with A-Z lowered, some megabyte of text at a time."""
    raw = text.encode().lower()
    at = 0
    while at < len(raw):
        cut = _GAP.search(raw, at + _PIECE)
        end = cut.start() if cut else len(raw)
        yield _TERM.findall(raw, at, end)
        at = end


@dataclass
class Tile:
    """Item counts over a part of the vocabulary: ``counts[i]`` is how often item ``items[i]`` says ``vocabulary[columns[i]]``."""

    vocabulary: np.ndarray  # numbers of terms, ascending
    items: np.ndarray  # numbers of items that have a row
    rows: np.ndarray
    columns: np.ndarray
    counts: np.ndarray

    def dense(self) -> np.ndarray:
        table = np.zeros((len(self.items), len(self.vocabulary)))
        np.add.at(table, (self.rows, self.columns), self.counts)
        return table


def tiles(items: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray) -> list[Tile]:
    """Cut (item, term, count) triples, ordered by item, into tiles.

    A tile has at most ``TILE_ITEMS`` items and ``TILE_TERMS`` terms, and the
    largest score that a row of it can give stays below 2**53. An item with more
    goes on in further tiles; a count too large for one is split.
    """
    most = weight[term] * (IMPACT // TF)  # no impact is larger
    fits = (EXACT - 1) // np.maximum(most, 1)
    parts = -(-count // fits)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    items, term, most, fits, left = (np.repeat(x, parts) for x in (items, term, most, fits, count))
    count = np.minimum(left - nth * fits, fits)
    made, begin = [], 0
    used, total = set(), {}

    def close(end: int) -> None:
        vocabulary, columns = np.unique(term[begin:end], return_inverse=True)
        numbers, at = np.unique(items[begin:end], return_inverse=True)
        made.append(Tile(vocabulary, numbers, at, columns, count[begin:end].astype(float)))

    for i, (item, t, value) in enumerate(zip(items.tolist(), term.tolist(), (most * count).tolist())):
        full = len(used) == TILE_TERMS and t not in used or len(total) == TILE_ITEMS and item not in total
        if full or total.get(item, 0) + value >= EXACT:
            close(i)
            begin, used, total = i, set(), {}
        used.add(t)
        total[item] = total.get(item, 0) + value
    if len(items):
        close(len(items))
    return made


def _postings(sent, names: list[str]):
    """Of each text its number of terms, and the numbers and counts of those that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in small(batches):
            lengths, sizes, found, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                n, own = 0, Counter()
                for some in terms(text):
                    n += len(some)
                    own.update(filter(None.__ne__, map(number.get, some)))
                lengths.append(n)
                sizes.append(sizes[-1] + len(own))
                found += own.keys()
                tfs += own.values()
            cuts = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(cuts, pa.array(found, pa.int32())),
                    pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int32())),
                ],
                names,
            )

    return run


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, doc: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What each posting adds: a term of ``weight`` that is ``tf`` times in document ``doc`` of ``length[doc]`` terms."""
    # in Python's numbers, as the product may pass 64 bits
    m = np.array([100 - 25 + 25 * n * documents // words for n in length.tolist()], np.int64)
    return weight * (IMPACT * tf // (TF * tf + LENGTH * m[doc]))


@dataclass
class Items:
    """What a pass over the documents needs of the items."""

    ids: pa.Array
    tiles: list[Tile]
    weight: np.ndarray  # by number of term
    documents: int
    words: int


def _search(sent, k: int, names: list[str]):
    """The best documents among the rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Items = sent.value
        best = Top(len(asked.ids), k, floor=1)
        place = np.full(len(asked.weight), -1)
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_DOCS):
                some = batch.slice(lo, TILE_DOCS)
                ids, length, lists = some.column(0), some.column(1).to_numpy(), some.column(2)
                term, tf = lists.flatten().to_numpy(), some.column(3).flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(some.num_rows), np.diff(lists.offsets.to_numpy()))
                added = impacts(asked.weight[term], tf, length, doc, asked.documents, asked.words).astype(float)
                score = np.zeros((len(asked.ids), some.num_rows), np.int64)
                for tile in asked.tiles:
                    place[tile.vocabulary] = np.arange(len(tile.vocabulary))
                    row = place[term]
                    place[tile.vocabulary] = -1
                    inside = row >= 0
                    table = np.zeros((len(tile.vocabulary), some.num_rows))
                    table[row[inside], doc[inside]] = added[inside]
                    score[tile.items] += (tile.dense() @ table).astype(np.int64)
                best.put_table(score, ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()))
        item = asked.ids.take(pa.array(best.group))
        yield pa.RecordBatch.from_arrays([item, pa.array(best.id, mask=best.missing), pa.array(best.score)], names)

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ids of both, ``rank`` from 1, ``score``.

    Terms are maximal runs of ASCII letters and digits and of all characters from
    U+0080 on, with only A-Z lowered. Over all documents, N counts those with a
    term, L all terms, df those with the term; n are a document's terms, tf those
    that are the term. A score sums, over the item's terms with repeats,
    ``w * (10**9 * tf div (1000 * tf + 12 * m))`` where ``w = floor(1000 * ln((2 * N
    + 2) / (2 * df + 1)))`` and ``m = 75 + 25 * n * N div L``. Documents that score 0
    are never returned; equal scores go by smaller id.

    Null texts have no terms. Rows with the same item id (null too) are one item
    that says all their terms; repeated documents each take a rank, and documents
    without an id come after others of the same score. Empty tables give nothing.
    Ids of documents must be whole numbers (ValueError). Other columns are ignored.

    A pass over the documents answers about ``PASS_ITEMS`` items with ``PASS_TERMS``
    terms; more items take more passes, each with the items that a hash deals to it.
    A pass stores, per document, only counts of terms that its items have, and each
    task keeps only ``k`` documents per item.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    if not isinstance(id_type, T.IntegralType):
        raise ValueError(f"{id_col} must be a whole number, not {id_type.simpleString()}")
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), whole(text_col).alias("_text"))
    kind = T.StructType(
        [
            T.StructField("_item", items.schema[item_col].dataType),
            T.StructField("_id", T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    )
    asked = _item_terms(items, item_col, item_text_col)
    n_items, n_terms = asked.agg(F.count_distinct(F.struct("_item")), F.count(F.lit(1))).first()
    passes = max(1, -(-n_items // PASS_ITEMS), -(-n_terms // PASS_TERMS))
    found = None
    for p in range(passes):
        # about PASS_TERMS rows
        rows = asked.where(F.pmod(F.xxhash64("_item"), F.lit(passes)) == p).orderBy("_item", "_term").toArrow()
        best = _pass(narrow, rows, k, kind)
        found = best if found is None else found.unionByName(best)
    ranked = best_rows(found, ["_item"], [F.desc("score"), F.asc_nulls_last("_id")], k)
    return ranked.select(F.col("_item").alias(item_col), "rank", F.col("_id").cast(id_type).alias(id_col), "score")


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Different terms of each item with their counts, written once: ``_item _term _count``."""
    narrow = items.select(F.col(item_col).alias("_item"), whole(text_col).alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            at, found, counts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own: Counter = Counter()
                for some in terms(text):
                    own.update(some)
                at += [i] * len(own)
                found += own.keys()
                counts += own.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.binary()), pa.array(counts, pa.int64())],
                ["_item", "_term", "_count"],
            )

    kind = T.StructType([narrow.schema["_item"], T.StructField("_term", T.BinaryType()), T.StructField("_count", T.LongType())])
    return cut_lineage(narrow.mapInArrow(split, kind).groupBy("_item", "_term").agg(F.sum("_count").alias("_count")))


def _pass(docs: DataFrame, rows: pa.Table, k: int, kind: T.StructType) -> DataFrame:
    """The best documents of every task for the items in ``rows``, which are ordered by item."""
    spark = docs.sparkSession
    item = rows.column("_item").combine_chunks()
    numbers = item.dictionary_encode(null_encoding="encode")
    vocabulary = rows.column("_term").combine_chunks().dictionary_encode()
    words = vocabulary.dictionary.to_pylist()
    sent = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    path = scratch_path(spark, "postings")
    docs.mapInArrow(_postings(sent, ["_id", "n", "terms", "tfs"]), "_id long, n long, terms array<int>, tfs array<int>").write.parquet(path)
    postings = spark.read.schema("_id long, n long, terms array<int>, tfs array<int>").parquet(path)
    documents, total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    frequency = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df[frequency.column("term").to_numpy()] = frequency.column("df").to_numpy()
    weight = np.floor(WEIGHT * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)
    made = tiles(
        numbers.indices.to_numpy(), vocabulary.indices.to_numpy(), rows.column("_count").to_numpy(), weight
    )
    asked = Items(numbers.dictionary, made, weight, documents, total)
    # documents without any of the terms score 0
    some = postings.where(F.size("terms") > 0)
    return some.mapInArrow(_search(spark.sparkContext.broadcast(asked), k, kind.names), kind)
