"""Statistics read off the counters: cardinality, flow sizes, entropy, heavy hitters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom import EPOCH
from packetloom.functions.expressions import bucket, flow_key, key_text
from packetloom.operators.counters import build_counters, look_up
from packetloom.operators.relational import _value, reduce_exact

LIGHT_MAX = 255  # light counters have 8 bits
#: parts of an epoch whose keys are ranked apart before the epoch is
SLICES = 64


def linear_counting(width: int, empty: Column) -> Column:
    """``w * ln(w / empty)``; null when no counter is empty."""
    w = F.lit(float(width))
    return F.when(empty > 0, w * F.log(w / empty))


def cardinality_linear(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str | int = 1,
    depth: int = 2,
    width: int = 524288,
    seed: int = 42,
    hash: str = "md5",
) -> DataFrame:
    """Estimated number of distinct keys per epoch from the empty level-1 counters, averaged over rows."""
    used = (
        build_counters(df, keys, value, depth, width, seed, hash)
        .where("_count > 0")
        .groupBy(EPOCH)
        .agg(F.count(F.lit(1)).alias("_used"))
    )
    return used.select(EPOCH, linear_counting(width, F.lit(width) - F.col("_used") / depth).alias("cardinality"))


def _light(df: DataFrame, keys: Sequence[str], width: int, seed: int, hash: str) -> Column:
    return F.expr(bucket(seed, key_text(keys), width, hash)).alias("bucket")


def light_count(
    df: DataFrame, keys: Sequence[str], value: Column | str | int = 1, width: int = 65536, seed: int = 42, hash: str = "md5"
) -> DataFrame:
    """One row of saturating 8-bit counters: ``(epoch_id, bucket, value)``, non-empty ones only."""
    sums = reduce_exact(df, keys, value, "_value").select(EPOCH, "_value", _light(df, keys, width, seed, hash))
    return sums.groupBy(EPOCH, "bucket").agg(F.least(F.sum("_value"), F.lit(LIGHT_MAX)).alias("value"))


def light_max(
    df: DataFrame, keys: Sequence[str], value: Column | str | int, width: int = 65536, seed: int = 42, hash: str = "md5"
) -> DataFrame:
    """Counters raised to the largest inserted value, at most 255."""
    capped = df.select(
        EPOCH, F.least(_value(value), F.lit(LIGHT_MAX).cast("long")).alias("_value"), _light(df, keys, width, seed, hash)
    )
    return capped.where("_value > 0").groupBy(EPOCH, "bucket").agg(F.max("_value").alias("value"))


def light_cardinality(light: DataFrame, width: int = 65536) -> DataFrame:
    """Estimated number of distinct keys per epoch in a light table."""
    used = light.groupBy(EPOCH).agg(F.count(F.when(F.col("value") > 0, 1)).alias("_used"))
    return used.select(EPOCH, linear_counting(width, F.lit(width) - F.col("_used")).alias("cardinality"))


def flow_size_distribution(light: DataFrame, width: int = 65536) -> DataFrame:
    """Number of counters holding each value 0 .. 255, all 256 bins in every epoch."""
    sizes = light.groupBy(EPOCH, "value").agg(F.count(F.lit(1)).alias("n"))
    # at most 256 entries per epoch, one for each value of an 8-bit counter
    per_epoch = sizes.groupBy(EPOCH).agg(
        F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("_n"),
        F.sum(F.when(F.col("value") > 0, F.col("n")).otherwise(0)).alias("_used"),
    )
    bins = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(LIGHT_MAX).cast("long")),
        lambda v: F.struct(
            v.alias("value"),
            F.when(v == 0, F.lit(width) - F.col("_used"))
            .otherwise(F.coalesce(F.try_element_at("_n", v), F.lit(0)))
            .alias("counters"),
        ),
    )
    return per_epoch.select(EPOCH, F.inline(bins))


def flow_entropy(light: DataFrame) -> DataFrame:
    """Per epoch: total size, sum of ``size * log2(size)`` and the entropy of the flow sizes."""
    sizes = light.where("value > 0").groupBy(EPOCH, "value").agg(F.count(F.lit(1)).alias("n"))
    size, n = F.col("value"), F.col("n")
    sums = sizes.groupBy(EPOCH).agg(
        F.sum(n * size).alias("total"), F.sum(n * size * F.log2(size.cast("double"))).alias("size_log_size")
    )
    return sums.withColumn("entropy", F.log2(F.col("total").cast("double")) - F.col("size_log_size") / F.col("total"))


def light_fold(light: DataFrame, width: int, ratio: int) -> DataFrame:
    """Shrink a light row to ``width // ratio`` counters, each the largest of those folded into it."""
    folded = width // ratio
    return (
        light.select(EPOCH, F.pmod("bucket", F.lit(folded)).alias("bucket"), "value")
        .groupBy(EPOCH, "bucket")
        .agg(F.max("value").alias("value"))
    )


def light_query(
    light: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    width: int = 65536,
    ratio: int = 1,
    seed: int = 42,
    hash: str = "md5",
    out: str = "estimate",
) -> DataFrame:
    """Counter of each distinct probe key, in a row folded by ``ratio``; 0 where it is empty."""
    named = probes.select(EPOCH, *keys).dropDuplicates()
    placed = named.withColumn("bucket", F.expr(f"({bucket(seed, key_text(keys), width, hash)}) % {width // ratio}L"))
    return look_up(placed, light, [EPOCH, "bucket"], keys, width // ratio, "left").select(
        EPOCH, *keys, F.coalesce("value", F.lit(0)).alias(out)
    )


def heavy_hitters(df: DataFrame, keys: Sequence[str], value: Column | str | int, k: int, out: str = "count") -> DataFrame:
    """The ``k`` keys with the largest sums in each epoch, ties by key.

    Keys are ranked within ``SLICES`` slices of an epoch first, so the window that
    ranks an epoch sees ``k`` rows per slice at most, whatever ``k`` is.
    """
    order = [F.desc(out), *keys]
    sliced = reduce_exact(df, keys, value, out).withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(SLICES)))
    return (
        sliced.withColumn("position", F.row_number().over(Window.partitionBy(EPOCH, "_slice").orderBy(*order)))
        .where(F.col("position") <= k)
        .drop("_slice")
        .withColumn("position", F.row_number().over(Window.partitionBy(EPOCH).orderBy(*order)))
        .where(F.col("position") <= k)
    )


def heavy_hitters_approx(
    df: DataFrame, keys: Sequence[str], k: int, max_items_tracked: int = 10000, out: str = "count"
) -> DataFrame:
    """The ``k`` most frequent keys per epoch from a bounded, mergeable frequent-items sketch."""
    top = F.call_function("approx_top_k", F.col("flow_key"), F.lit(k), F.lit(max_items_tracked))
    return (
        df.select(EPOCH, flow_key(keys).alias("flow_key"))
        .groupBy(EPOCH)
        .agg(top.alias("_top"))
        .select(EPOCH, F.inline("_top"))
        .select(EPOCH, F.col("item").alias("flow_key"), F.col("count").alias(out))
    )
