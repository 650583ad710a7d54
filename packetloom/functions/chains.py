"""Following chains of steps that are spread over many tasks, without walking them one by one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.storage import cut_lineage


def reached(steps: DataFrame, roots: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``within, start`` of all places on the chains from ``roots``; ``steps`` has ``within, start, next`` (null: the end).

    Each turn adds the places that lie as far on again as those known reach, then
    takes every step twice: as many turns as the logarithm of the longest chain.
    """
    place = [*within, "start"]
    known = roots.select(*place)
    steps = steps.where("next IS NOT NULL")
    while not steps.isEmpty():
        further = known.join(steps, place).select(*within, F.col("next").alias("start"))
        known = cut_lineage(known.unionByName(further))
        twice = steps.select(*within, F.col("start").alias("_from"), F.col("next").alias("start")).join(steps, place)
        steps = cut_lineage(twice.select(*within, F.col("_from").alias("start"), "next"))
    return known


def first_at_least(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``value, found``: for each different ``value`` of ``asked`` the smallest ``value`` of ``known`` that is not below it.

    Null where there is none. Both tables lie in one order, sorted by ranges over
    all tasks and written once; a range needs nothing of the others but the first
    known value of each.
    """
    both = asked.select("value", F.lit(None).cast("long").alias("_known"), F.lit(True).alias("_asked")).distinct().unionByName(
        known.select("value", F.col("value").alias("_known"), F.lit(False).alias("_asked"))
    )
    ordered = cut_lineage(both.orderBy("value").withColumn("_slice", F.spark_partition_id()))
    # seen from the end: a frame that grows by a row is summed as it goes, one that loses a row is summed anew for each row
    after = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = ordered.groupBy("_slice").agg(F.min("_known").alias("_least"))
    ahead = slices.select("_slice", F.min("_least").over(after).alias("_ahead"))
    # a range of values: equal ones count, however they lie
    here = Window.partitionBy("_slice").orderBy(F.desc("value")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = ordered.withColumn("_here", F.min("_known").over(here)).where("_asked").join(ahead, "_slice")
    return found.select("value", F.coalesce("_here", "_ahead").alias("found"))
