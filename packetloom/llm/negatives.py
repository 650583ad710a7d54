"""Hard negatives: rows of another label that are nearly as close to an anchor as one of its positives.

A threshold join in the way of L2AP. Anchors are indexed by dimension, but only as
far as a norm bound demands: where the norm of an anchor's remaining dimensions
times the norm of a row cannot reach the anchor's threshold, they stay out. Rows
meet the index one chunk of dimensions after another; a pair is given up as soon as
its partial score plus the product of the remaining norms is below the threshold.
Thresholds start high and are lowered for those anchors whose windows did not fill.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.expressions import floor_div
from packetloom.functions.storage import cut_lineage, scratch_path
from packetloom.llm.topk import Top, best_rows

SCALE = 256
# rows whose scores only choose the thresholds to begin with; no result depends on them
SAMPLE_ROWS = 2048
# places in the sample whose scores are tried as thresholds, before all the rest
PLACES = (1, 32)
# anchors of one pass over the rows
PASS_ANCHORS = 8192
CHUNK = 16  # dimensions between two looks at the bounds
TILE = 1024
FEW = 16  # one in so many pairs left: go on pair by pair
SLACK = 1 + 1e-9  # for the rounding of norms
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def whole_numbers(lists: pa.ListArray, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``floor(256 * x)`` of every component, rows x dimensions, and which rows are finite.

    Shorter rows end in zeros; ``dims`` cuts longer ones (which then only meet zeros).
    """
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE)
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    finite = np.ones(len(sizes), bool)
    finite[row[~np.isfinite(flat)]] = False
    longest = max(int(sizes.max(initial=0)), 1) if dims is None else dims
    table = np.zeros((len(sizes), longest))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = (at < longest) & finite[row]
    table[row[inside], at[inside]] = flat[inside]
    return table, finite


def _exact_in(a: np.ndarray, b: np.ndarray) -> type:
    """The number type that holds all sums of products of ``a`` and ``b`` rows exactly."""
    most = float(a.max(initial=0)) * float(b.max(initial=0)) * SLACK
    if max(most, a.max(initial=0), b.max(initial=0)) >= HIGHEST:
        raise ValueError("inner products must fit in 64 bits")
    return float if most < 1 << 53 else np.int64


class DimensionIndex:
    """Anchor vectors by chunks of dimensions, the most energetic first, with the norm of what follows each chunk."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.argsort(-(vectors**2).sum(axis=0), kind="stable")
        self.vectors = vectors[:, self.order]
        self.cuts = [*range(0, vectors.shape[1], CHUNK), vectors.shape[1]]
        self.rest = self._rest(self.vectors)

    def _rest(self, vectors: np.ndarray) -> np.ndarray:
        """Norms of the dimensions from each cut on."""
        square = np.zeros((len(vectors), vectors.shape[1] + 1))
        square[:, :-1] = np.cumsum(vectors[:, ::-1] ** 2, axis=1)[:, ::-1]
        return np.sqrt(square[:, self.cuts])

    def pairs(self, rows: np.ndarray, threshold: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Anchor, row and score of all pairs that reach the anchor's ``threshold``.

        Long rows come together, and short ones, so that the bound fits the rows of a tile.
        """
        rows = rows[:, self.order]
        rest = self._rest(rows)
        by_norm = np.argsort(-rest[:, 0], kind="stable")
        kind = _exact_in(self.rest[:, 0], rest[:, 0])
        own = self.vectors.astype(kind)
        for lo in range(0, len(rows), TILE):
            some = by_norm[lo : lo + TILE]
            # chunks of each anchor that are indexed; an anchor of none cannot reach its threshold
            reach = self.rest * (rest[some[0], 0] * SLACK) >= _soft(threshold)[:, None]
            depth = np.minimum(reach.sum(axis=1), len(self.cuts) - 1)
            listed = np.argsort(-depth, kind="stable")[: np.count_nonzero(depth)]
            for at in range(0, len(listed), TILE):
                anchors = listed[at : at + TILE]
                anchor, row, score = _tile(
                    own[anchors], self.rest[anchors], depth[anchors], threshold[anchors], rows[some].astype(kind), rest[some], self.cuts
                )
                yield anchors[anchor], some[row], score


def _soft(threshold: np.ndarray) -> np.ndarray:
    return threshold - (SLACK - 1) * np.abs(threshold)


def _tile(own, left, depth, threshold, rows, rest, cuts):
    """Accumulate the indexed chunks over all pairs of a tile until few are able to reach the threshold, then pair by pair.

    ``own``: anchors by falling ``depth``; ``left`` and ``rest``: norms of anchors and rows from each cut on.
    """
    score = np.zeros((len(own), len(rows)), own.dtype)
    limit = _soft(threshold)
    for c in range(len(cuts) - 1):
        lo, hi = cuts[c], cuts[c + 1]
        listed = np.count_nonzero(depth > c)  # the postings of a chunk
        score[:listed] += own[:listed, lo:hi] @ rows[:, lo:hi].T
        # what is not indexed of an anchor counts among its remaining norms
        met = np.minimum(depth, c + 1)
        able = score + SLACK * left[np.arange(len(own)), met][:, None] * rest[:, met].T >= limit[:, None]
        if np.count_nonzero(able) * FEW <= able.size:
            break
    anchor, row = np.nonzero(able)
    score, met = score[able], met[anchor]
    for c in range(int(met.min(initial=len(cuts))), len(cuts) - 1):
        lo, hi = cuts[c], cuts[c + 1]
        due = np.flatnonzero(met == c)
        for at in range(0, len(due), 1 << 16):
            part = due[at : at + (1 << 16)]
            score[part] += np.einsum("ij,ij->i", own[anchor[part], lo:hi], rows[row[part], lo:hi])
        met[due] += 1
        able = score + SLACK * left[anchor, met] * rest[row, met] >= limit[anchor]
        anchor, row, score, met = anchor[able], row[able], score[able], met[able]
    able = score >= threshold[anchor]
    return anchor[able], row[able], score[able].astype(np.int64)


@dataclass
class Asked:
    """Anchors and their windows of scores; rows of ``low <= score <= high`` are in a window, the highest first."""

    numbers: np.ndarray  # of the anchors within the pass
    ids: np.ndarray
    labels: np.ndarray  # places in ``names``
    names: pa.Array
    vectors: np.ndarray
    low: np.ndarray  # anchors x windows
    high: np.ndarray
    same: bool  # rows of the anchor's label, or of the others


def _parsed(batches: Iterator[pa.RecordBatch], names: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, places of labels in ``names`` (-1: none) and vectors of the rows that take part."""
    for batch in batches:
        table, finite = whole_numbers(batch.column(2), dims)
        label = pc.fill_null(pc.index_in(batch.column(1), value_set=names), -1).to_numpy()
        yield batch.column(0).to_numpy()[finite], label[finite], table[finite]


def _groups(label: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(label, kind="stable")
    names, begin = np.unique(label[order], return_index=True)
    return dict(zip(names.tolist(), np.split(order, begin[1:]), strict=True)) if len(names) else {}


_FOUND = "_n int, _anchor long, _high long, _id long, score long"


def _fill(sent, k: int):
    """The first ``k`` rows of every window among the rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = sent.value
        width = asked.low.shape[1]
        top = Top(asked.low.size, k, asked.low.ravel())
        every = {0: np.arange(len(asked.ids))}
        parts = _groups(asked.labels) if asked.same else every
        index = {n: DimensionIndex(asked.vectors[own]) for n, own in parts.items()}
        for ids, label, rows in _parsed(batches, asked.names, asked.vectors.shape[1]):
            for n, some in (_groups(label) if asked.same else {0: np.arange(len(ids))}).items():
                if n not in parts:
                    continue
                own = parts[n]
                # windows filled so far lift the threshold within the task
                limit = top.floor.reshape(-1, width)[own].min(axis=1).astype(float)
                for a, r, score in index[n].pairs(rows[some], limit):
                    anchor, row = own[a], some[r]
                    fits = ids[row] != asked.ids[anchor] if asked.same else label[row] != asked.labels[anchor]
                    anchor, row, score = anchor[fits], row[fits], score[fits]
                    for w in range(width):
                        inside = score <= asked.high[anchor, w]
                        top.put(anchor[inside] * width + w, score[inside], ids[row[inside]])
        anchor, window = np.divmod(top.group, width)
        columns = asked.numbers[anchor].astype(np.int32), asked.ids[anchor], asked.high[anchor, window], top.id, top.score
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _FOUND.split(", ")])

    return run


class _Pass:
    """Some anchors against all rows."""

    def __init__(self, rows: DataFrame, anchors: pa.Table, sample: pa.Table) -> None:
        self.rows, self.spark = rows, rows.sparkSession
        vectors, finite = whole_numbers(anchors.column("_vector").combine_chunks())
        encoded = anchors.column("_label").combine_chunks().dictionary_encode()
        self.names, self.labels = encoded.dictionary, encoded.indices.to_numpy()[finite]
        self.ids, self.vectors = anchors.column("_id").to_numpy()[finite], vectors[finite]
        own = list(_parsed(sample.to_batches(), self.names, self.vectors.shape[1]))
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), self.vectors[:0])]
        self.sample_ids, self.sample_labels, self.sample = map(np.concatenate, zip(*(own or none), strict=True))

    def thresholds(self, anchors: np.ndarray, high: np.ndarray, same: bool, place: int) -> np.ndarray:
        """Score at ``place`` among the rows of the sample that are in a window; the lowest of all if there are fewer."""
        out = np.full(high.shape, LOWEST)
        if place > len(self.sample):
            return out
        for lo in range(0, len(anchors), TILE):
            some = anchors[lo : lo + TILE]
            score = self.vectors[some] @ self.sample.T
            fits = (self.labels[some][:, None] == self.sample_labels) == same
            if same:
                fits &= self.ids[some][:, None] != self.sample_ids
            for w in range(high.shape[1]):
                inside = np.where(fits & (score <= high[lo : lo + TILE, w, None]), score, -np.inf)
                nth = np.partition(inside, -place, axis=1)[:, -place]
                out[lo : lo + TILE, w] = np.where(np.isfinite(nth), nth, LOWEST).astype(np.int64)
        return out

    def fill(self, low: np.ndarray, high: np.ndarray, same: bool, k: int, path: str) -> DataFrame:
        """Write the first ``k`` rows of every window (anchors x windows; none where ``low > high``) below ``path``.

        Thresholds are lowered for windows that are not full, down to ``low``. A
        window is written in each turn that it is looked at; what was found under a
        higher threshold comes first under a lower one too, so ranks agree.
        """
        still = low <= high
        turns: list[DataFrame] = []
        for place in (*PLACES, None):
            anchors = np.flatnonzero(still.any(axis=1))
            if not len(anchors) and turns:
                break
            least = np.where(still, low, HIGHEST)[anchors]
            start = least if place is None else np.maximum(least, self.thresholds(anchors, high[anchors], same, place))
            asked = Asked(anchors, self.ids[anchors], self.labels[anchors], self.names, self.vectors[anchors], start, high[anchors], same)
            found = self.rows.mapInArrow(_fill(self.spark.sparkContext.broadcast(asked), k), _FOUND)
            to = f"{path}/{len(turns)}"
            best_rows(found, ["_n", "_anchor", "_high"], [F.desc("score"), F.asc("_id")], k).write.parquet(to)
            turns.append(self.spark.read.parquet(to))
            full = turns[-1].where(F.col("rank") == k).select("_n", "_high").toArrow()  # at most a row per window
            still[anchors] &= start > least
            n, top = full.column("_n").to_numpy(), full.column("_high").to_numpy()
            np.logical_and.at(still, n, high[n] != top[:, None])
        return reduce(DataFrame.unionByName, turns).dropDuplicates(["_n", "_high", "rank"])


def mine(
    rows: DataFrame,
    is_anchor: Column | str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id positive_id rank negative_id positive_score negative_score``.

    A component counts as ``floor(256 * x)``, a score is the inner product of the
    whole numbers. An anchor's positives are the ``positives`` rows of the highest
    scores among those of its label and another id; the hard negatives of a
    positive are the first ``negatives`` rows of other labels with ``low_percent *
    positive_score <= 100 * negative_score <= high_percent * positive_score``. Equal
    scores go by smaller id.

    Rows without an id, label or vector, or with a null or non-finite component take
    no part. Missing trailing components count as 0. A repeated row counts as often
    as it occurs, as anchor, positive and negative. Nothing in, nothing out; other
    columns are ignored. Ids must be whole numbers, and scores fit in 64 bits
    (ValueError).

    A pass answers about ``PASS_ANCHORS`` anchors, dealt by a hash, against all rows.
    A task returns at most ``positives`` or ``negatives`` rows per window, however
    many copies an anchor has; only anchors, positive scores and full windows of one
    pass are gathered on the driver.
    """
    spark = rows.sparkSession
    id_type = rows.schema[id_col].dataType
    if not isinstance(id_type, T.IntegralType):
        raise ValueError(f"{id_col} must be a whole number, not {id_type.simpleString()}")
    mark = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    marked = rows.select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(label_col).cast("string").alias("_label"),
        F.col(vector_col).cast("array<double>").alias("_vector"),
        mark.alias("_is_anchor"),
    ).dropna(subset=["_id", "_label", "_vector"])
    narrow = marked.drop("_is_anchor")
    n_rows = narrow.count()
    # only thresholds to begin with come from it
    sample = narrow.sample(min(1.0, SAMPLE_ROWS / max(n_rows, 1)), seed=1).limit(2 * SAMPLE_ROWS).toArrow()
    anchors = cut_lineage(marked.where("_is_anchor").drop("_is_anchor").withColumn("_place", F.monotonically_increasing_id()))
    n_anchors = anchors.count()
    passes = max(1, -(-n_anchors // PASS_ANCHORS))
    found = None
    for p in range(passes):
        own = anchors.where(F.pmod(F.xxhash64("_place"), F.lit(passes)) == p).orderBy("_id", "_place").drop("_place").toArrow()
        path = scratch_path(spark, "negatives")
        near = _Pass(narrow, own, sample)
        shape = (len(near.ids), 1)
        first = near.fill(np.full(shape, LOWEST), np.full(shape, HIGHEST), True, positives, f"{path}/positives")
        scored = first.select("_n", F.col("score").alias("_score")).distinct().toArrow()
        low, high = _windows(scored, len(near.ids), positives, low_percent, high_percent)
        hard = near.fill(low, high, False, negatives, f"{path}/negatives")
        hundreds, rest = floor_div("score", 100), F.pmod("score", F.lit(100))
        kept = first.select(
            "_n",
            F.col("_anchor").alias("anchor_id"),
            F.col("_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
            (hundreds * high_percent + F.floor(rest * high_percent / 100)).alias("_high"),
        )
        joined = kept.join(hard.select("_n", "_high", "rank", F.col("_id").alias("negative_id"), F.col("score").alias("negative_score")), ["_n", "_high"])
        found = joined if found is None else found.unionByName(joined)
    ids = [F.col(c).cast(id_type).alias(c) for c in ("anchor_id", "positive_id", "negative_id")]
    return found.select(ids[0], ids[1], "rank", ids[2], "positive_score", "negative_score")


def _windows(scored: pa.Table, anchors: int, most: int, low_percent: int, high_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of the windows of each anchor, one for each different score of a positive."""
    low, high = np.full((anchors, most), HIGHEST), np.full((anchors, most), LOWEST)
    n, score = scored.column("_n").to_numpy(), scored.column("_score").to_numpy()
    order = np.argsort(n, kind="stable")
    n, (hundreds, rest) = n[order], np.divmod(score[order], 100)
    nth = np.arange(len(n)) - np.searchsorted(n, n)
    low[n, nth] = hundreds * low_percent - (-rest * low_percent) // 100
    high[n, nth] = hundreds * high_percent + rest * high_percent // 100
    return low, high
