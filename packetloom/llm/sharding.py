"""Weighted rendezvous hashing: a record's key alone decides its shard, and a new shard takes rows only into itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.ordering import positions
from packetloom.functions.storage import cut_lineage
from packetloom.llm.columns import packed, unpacked

# hexadecimal digits of the digest that make the draw: 52 bits, which a double holds exactly
_DIGITS = 13


def rendezvous_scores(key: Column, weights: Sequence[float]) -> Column:
    """An array with the score of ``key`` in each shard; the largest one wins.

    The draw of a key and a shard is uniform in (0, 1) and depends on nothing
    else, so ``ln(draw) / weight`` picks each shard with a chance in proportion
    to its weight, and another shard changes no score of the others.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def score(shard: Column) -> Column:
        digest = F.md5(F.concat(key, F.lit("/"), shard.cast("string")))
        draw = (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
        weight = F.lit(1.0) if len(set(weights)) == 1 else F.element_at(F.array(*map(F.lit, weights)), shard + 1)
        return F.log(draw) / weight

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score)


def assign_shards(
    df: DataFrame,
    key: str,
    weights: Sequence[float],
    grown_by: float | None = None,
    shard: str = "shard",
    grown: str = "grown_shard",
) -> DataFrame:
    """Add the shard of each row, and with ``grown_by`` its shard if one shard of that weight joined.

    A null key counts as the empty key. Equal scores (of no practical chance) go
    to the smaller shard. Rows with the same key share a shard. No shuffle.
    """
    n = len(weights)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    all_weights = [*map(float, weights), *([float(grown_by)] if grown_by is not None else [])]
    scored = packed(df, _scores=rendezvous_scores(name, all_weights))
    best = scored.withColumn("_best", F.array_max(F.slice("_scores", 1, n)))
    placed = best.withColumn("_shard", (F.array_position("_scores", F.col("_best")) - 1).cast("int"))
    added = {shard: F.col("_shard")}
    if grown_by is not None:
        added[grown] = F.when(F.element_at("_scores", n + 1) > F.col("_best"), F.lit(n)).otherwise(F.col("_shard"))
    return unpacked(placed, df.columns, added)


def number_slots(df: DataFrame, order: str, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... by ``order`` (null first) without bringing a shard into one task.

    The rows (pass only narrow ones) are written once, which gives each a place
    that breaks ties between equal ones; then they are sorted by ranges over all
    tasks, and a range only needs the row counts of the ranges before it.
    """
    fixed = packed(cut_lineage(df), _shard=F.col(shard), _order=F.col(order), _tie=F.monotonically_increasing_id())
    numbered = positions(fixed, "_shard", [F.col("_order"), F.col("_tie")], "_nth")
    return unpacked(numbered, df.columns, {slot: F.col("_nth") - 1})
