"""Running sums and positions that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.storage import cut_lineage, measured


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right
    for c in on:
        renamed = renamed.withColumnRenamed(c, f"_r_{c}")
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def running_sum(
    df: DataFrame,
    parts: Sequence[str],
    order: str,
    value: Column | str,
    out: str,
    block_bits: int = 20,
) -> DataFrame:
    """Sum of ``value`` over the rows of the same ``parts`` up to this row in ``order``.

    ``order`` is a unique LONG. A group is cut into blocks of ``2**block_bits``
    order values, so no task sorts more than that many rows of one group however
    hot its key is. Block totals are combined map-side; only they (one row per
    group and block) pass through a window over the whole group.
    """
    blocked = df.withColumn("_value", F.col(value) if isinstance(value, str) else value).withColumn(
        "_block", F.shiftright(F.col(order), block_bits)
    )
    group = [*parts, "_block"]
    before = Window.partitionBy(*parts).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*group)
        .agg(F.sum("_value").alias("_total"))
        .select(*group, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried"))
    )
    inside = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = blocked.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        _null_safe_join(summed, carried, group)
        .withColumn(out, F.col("_inside") + F.col("_carried"))
        .drop("_value", "_block", "_inside", "_carried")
    )


def positions(df: DataFrame, part: str, order: Sequence[Column], out: str = "position", in_order: bool = False) -> DataFrame:
    """Number the rows of each ``part`` 1, 2, 3, ... in ``order``.

    The global sort is range-partitioned, so a huge part spreads over many tasks.
    It is written once; then each sorted slice only needs the row counts of the
    slices before it (one row per part and slice, written too: the rows stay where
    they are if Spark can broadcast these). With ``in_order`` the rows already lie
    in this order from slice to slice, and there is no sort.
    """
    lying = df if in_order else df.orderBy(F.col(part), *order)
    ordered = cut_lineage(lying.withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    slices = ordered.groupBy(part, "_slice").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        part, "_slice", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        _null_safe_join(ordered, measured(offsets), [part, "_slice"])
        .withColumn(out, F.col("_at") + F.col("_shift") + 1)
        .drop("_slice", "_at", "_shift")
    )


def total_before(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before this one in ``order``, for tables of narrow rows.

    The rows are sorted by ranges over all tasks and written once; one row per range meets in a window.
    """
    ordered = cut_lineage(
        df.orderBy(order).withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    )
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ordered.groupBy("_slice").agg(F.sum(value).alias("_total"))
    offsets = slices.select("_slice", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = ordered.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(offsets, "_slice").withColumn(out, F.col("_inside") + F.col("_ahead")).drop("_slice", "_at", "_inside", "_ahead")
