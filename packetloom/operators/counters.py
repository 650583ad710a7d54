"""Counter-array sketches as plans: Count-Min, counter tree (FCM), first layer only, Elastic.

A sketch is a *table* ``(epoch_id, _row, _bucket, ...)`` with at most
``depth * width`` rows per epoch. Inserting is a sum per bucket, probing is a join.
Additive sketches first sum per exact key (map-side combine), so a hot key costs
one row before rows are multiplied by ``depth``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom import EPOCH, SEQ
from packetloom.functions.expressions import bucket, key_text, quoted
from packetloom.functions.ordering import running_sum
from packetloom.functions.skew import salted_lookup, salts_for
from packetloom.functions.storage import cut_lineage
from packetloom.operators.relational import _value

SLOT = (EPOCH, "_row", "_bucket")
ARY_BITS = 3  # the counter tree is 8-ary


def cms_width(memory_in_bytes: int, depth: int) -> int:
    """Counters per row when ``depth`` rows of 4-byte counters share the memory."""
    return memory_in_bytes // 4 // depth


def slots(df: DataFrame, keys: Sequence[str], depth: int, width: int, seed: int, hash: str) -> DataFrame:
    """One output row per input row and hash row, with its ``_row`` and ``_bucket``."""
    pairs = [f"struct({i} AS _row, {bucket(seed + i, '_text', width, hash)} AS _bucket)" for i in range(depth)]
    # two projections: the key text is built once per row, not once per hash row
    return df.selectExpr("*", f"{key_text(keys)} AS _text").selectExpr(
        *[quoted(c) for c in df.columns], f"inline(array({', '.join(pairs)}))"
    )


def look_up(
    placed: DataFrame, table: DataFrame, on: Sequence[str], keys: Sequence[str], width: int, how: str = "inner"
) -> DataFrame:
    """Join placed keys to a sketch table; the keys of one bucket are split if buckets are few."""
    return salted_lookup(placed, table, on, keys, salts_for(width), how)


def _key_sums(df: DataFrame, keys: Sequence[str], value: Column | str | int) -> DataFrame:
    """Exact sum per key. The last filter is what both later uses share, so that
    the shuffle behind this table is computed once and reused."""
    return (
        df.select(EPOCH, *keys, _value(value).alias("_value"))
        .where(F.col("_value").isNotNull())
        .groupBy(EPOCH, *keys)
        .agg(F.sum("_value").alias("_value"))
        .where(F.col("_value").isNotNull())
    )


def build_counters(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str | int,
    depth: int,
    width: int,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """Sketch table ``(epoch_id, _row, _bucket, _count)``."""
    return _fill(_key_sums(df, keys, value), keys, depth, width, seed, hash)


def _fill(sums: DataFrame, keys: Sequence[str], depth: int, width: int, seed: int, hash: str) -> DataFrame:
    return slots(sums, keys, depth, width, seed, hash).groupBy(*SLOT).agg(F.sum("_value").alias("_count"))


def _read(
    sums: DataFrame, estimates: DataFrame, keys: Sequence[str], out: str, depth: int, width: int, seed: int, hash: str
) -> DataFrame:
    """Smallest estimate over the rows of every key in ``sums``."""
    return (
        look_up(slots(sums, keys, depth, width, seed, hash), estimates, SLOT, keys, width)
        .groupBy(EPOCH, *keys)
        .agg(F.min("_estimate").alias(out))
    )


def point_estimate(
    table: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    depth: int,
    width: int,
    seed: int = 42,
    hash: str = "md5",
    out: str = "estimate",
) -> DataFrame:
    """Estimate of each probe key (rows ``epoch_id, keys``), whether it was inserted or not."""
    named = probes.select(EPOCH, *keys).dropDuplicates()
    return (
        look_up(slots(named, keys, depth, width, seed, hash), table, SLOT, keys, width, "left")
        .groupBy(EPOCH, *keys)
        .agg(F.min(F.coalesce("_count", F.lit(0))).alias(out))
    )


def reduce_cms(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str | int,
    out: str = "count",
    memory_in_bytes: int = 524288,
    depth: int = 3,
    seed: int = 42,
    hash: str = "md5",
    mode: str = "final",
) -> DataFrame:
    """Count-Min estimate per key, never below the exact sum.

    ``mode="final"`` reads the sketch at the end of the epoch; ``"arrival"`` reads
    it at the key's last packet.
    """
    width = cms_width(memory_in_bytes, depth)
    if mode == "arrival":
        return _reduce_arrival(df, keys, value, out, depth, width, seed, hash)
    if mode != "final":
        raise ValueError(f"unknown mode {mode!r}: use 'final' or 'arrival'")
    return reduce_fcm_l1(df, keys, value, out, depth, width, seed, hash)


def reduce_fcm_l1(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str | int,
    out: str = "count",
    depth: int = 2,
    width_l1: int = 524288,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """Smallest of ``depth`` counters per key, given the row width directly; no promotion."""
    sums = _key_sums(df, keys, value)
    estimates = _fill(sums, keys, depth, width_l1, seed, hash).withColumnRenamed("_count", "_estimate")
    return _read(sums, estimates, keys, out, depth, width_l1, seed, hash)


def reduce_elastic(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str | int,
    out: str = "count",
    depth: int = 4,
    width: int = 1024,
    seed: int = 42,
    hash: str = "md5",
    heavy_threshold: int = 10000,
) -> DataFrame:
    """Smallest light counter per key; ``is_heavy`` when all its light counters exceed the threshold."""
    light = reduce_fcm_l1(df, keys, value, out, depth, width, seed, hash)
    return light.withColumn("is_heavy", F.col(out) > heavy_threshold)


def _check_tree(width_l1: int, width_l2: int, width_l3: int, threshold_l1: int, threshold_l2: int) -> None:
    if width_l1 > width_l2 << ARY_BITS or width_l2 > width_l3 << ARY_BITS:
        raise ValueError("each level needs at least an eighth of the counters of the level below")
    if threshold_l2 < threshold_l1:
        raise ValueError("threshold_l2 must not be below threshold_l1")


def reduce_fcm(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str | int,
    out: str = "count",
    depth: int = 2,
    width_l1: int = 524288,
    width_l2: int = 65536,
    width_l3: int = 8192,
    threshold_l1: int = 254,
    threshold_l2: int = 65534,
    seed: int = 42,
    hash: str = "md5",
    mode: str = "overflow",
    heavy_threshold: int | None = None,
) -> DataFrame:
    """Estimate per key from a three-level, 8-ary tree of counters.

    ``"overflow"``: a counter above its threshold passes the excess to its parent;
    sums only, so it is mergeable, order-free and never below the exact sum.
    ``"arrival"``: packets in ``seq`` order, the whole value is promoted once a
    counter is over its threshold, and the sketch is read at the key's last packet.
    Values must not be negative there.

    With ``heavy_threshold`` a key ``is_heavy`` when its estimates in all rows exceed it.
    """
    _check_tree(width_l1, width_l2, width_l3, threshold_l1, threshold_l2)
    if heavy_threshold is not None:
        estimated = reduce_fcm(
            df, keys, value, out, depth, width_l1, width_l2, width_l3, threshold_l1, threshold_l2, seed, hash, mode
        )
        return estimated.withColumn("is_heavy", F.col(out) > heavy_threshold)
    t1, t2 = threshold_l1, threshold_l2
    if mode == "arrival":
        return _reduce_arrival(df, keys, value, out, depth, width_l1, seed, hash, t1, t2, width_l2)
    if mode != "overflow":
        raise ValueError(f"unknown mode {mode!r}: use 'overflow' or 'arrival'")
    sums = _key_sums(df, keys, value)
    level1 = _fill(sums, keys, depth, width_l1, seed, hash)
    # a root covers 64 buckets, so both windows stay that small and share one shuffle
    root = [EPOCH, "_row", "_root"]
    in_parent = Window.partitionBy(*root, "_parent")
    tree = (
        level1.selectExpr("*", f"shiftright(_bucket, {ARY_BITS}) AS _parent", f"shiftright(_bucket, {2 * ARY_BITS}) AS _root")
        .repartition(*root)
        .withColumn("_l2", F.sum(F.greatest(F.col("_count") - t1, F.lit(0))).over(in_parent))
        .withColumn("_nth", F.row_number().over(in_parent.orderBy("_bucket")))
    )
    # every child row carries its parent's excess: count it once
    excess = F.when(F.col("_nth") == 1, F.greatest(F.col("_l2") - (t2 - t1), F.lit(0)))
    estimates = tree.withColumn("_l3", F.sum(excess).over(Window.partitionBy(*root))).selectExpr(
        *SLOT,
        f"CASE WHEN _count <= {t1} THEN _count WHEN _l2 + {t1} <= {t2} THEN _l2 + {t1} ELSE _l3 + {t2} END AS _estimate",
    )
    return _read(sums, estimates, keys, out, depth, width_l1, seed, hash)


def crossings(rows: DataFrame, counter: Sequence[str], limit: int, out: str, block_bits: int = 20) -> DataFrame:
    """For each ``counter`` whose sum of ``_v`` (never negative) passes ``limit``, the ``seq`` at which it does.

    Sums of blocks of ``2**block_bits`` order values, combined map-side, tell the block
    in which a counter passes; only that block is looked at packet by packet. The
    result, a row per counter at most, is written out.
    """
    blocked = rows.withColumn("_block", F.shiftright(SEQ, block_bits))
    totals = blocked.groupBy(*counter, "_block").agg(F.sum("_v").alias("_total"))
    upto = Window.partitionBy(*counter).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passing = (
        totals.withColumn("_upto", F.sum("_total").over(upto))
        .withColumn("_before", F.col("_upto") - F.col("_total"))
        .where((F.col("_upto") > limit) & (F.col("_before") <= limit))
        .select(*counter, "_block", "_before")
    )
    inside = Window.partitionBy(*counter).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = blocked.join(passing, [*counter, "_block"]).withColumn("_upto", F.col("_before") + F.sum("_v").over(inside))
    return cut_lineage(summed.where(F.col("_upto") > limit).groupBy(*counter).agg(F.min(SEQ).alias(out)))


def _reduce_arrival(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str | int,
    out: str,
    depth: int,
    width: int,
    seed: int,
    hash: str,
    t1: int | None = None,
    t2: int | None = None,
    width_l2: int = 0,
) -> DataFrame:
    """Counters as they stand at each packet.

    Sums only grow, so a counter passes its threshold once, at a ``seq`` that is found
    first. Comparing with it tells the level at which a packet is counted last, and
    the counter there holds just the packets of that level: one running sum per
    level and counter, and nothing is stored but the crossing points.
    """
    rows = slots(
        df.select(EPOCH, SEQ, *keys, _value(value).alias("_v")).where(F.col("_v").isNotNull()),
        keys,
        depth,
        width,
        seed,
        hash,
    )
    if t1 is None:
        estimated = running_sum(rows, SLOT, SEQ, "_v", "_estimate")
    else:
        parent = (EPOCH, "_row", "_parent")
        rows = rows.withColumn("_parent", F.shiftright("_bucket", ARY_BITS))
        first = crossings(rows, SLOT, t1, "_first")
        promoted = look_up(rows, first, SLOT, keys, width).where(F.col(SEQ) >= F.col("_first"))
        second = crossings(promoted, parent, t2 - t1, "_second")
        placed = look_up(look_up(rows, first, SLOT, keys, width, "left"), second, parent, keys, width_l2, "left")
        never = F.lit(2**63 - 1)
        at_first = F.col(SEQ) < F.coalesce("_first", never)
        at_second = F.col(SEQ) < F.coalesce("_second", never)

        def at(level: int, counter: Column, passed: int) -> Column:
            return F.struct(F.lit(level).alias("_level"), counter.alias("_counter"), F.lit(passed).alias("_passed"))

        root = F.shiftright("_parent", ARY_BITS)
        level = F.when(at_first, at(1, F.col("_bucket"), 0)).when(at_second, at(2, F.col("_parent"), t1)).otherwise(at(3, root, t1 + t2))
        leveled = placed.select(EPOCH, SEQ, *keys, "_row", "_v", level.alias("_at")).select(EPOCH, SEQ, *keys, "_row", "_v", "_at.*")
        summed = running_sum(leveled, [EPOCH, "_row", "_level", "_counter"], SEQ, "_v", "_sum")
        estimated = summed.withColumn("_estimate", F.col("_sum") + F.col("_passed"))
    return (
        estimated.groupBy(EPOCH, *keys, "_row")
        .agg(F.max_by("_estimate", SEQ).alias("_estimate"))
        .groupBy(EPOCH, *keys)
        .agg(F.min("_estimate").alias(out))
    )
