"""Frame accounting, epoch reports and the report sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import EPOCH
from packetloom.functions.expressions import flow_key
from packetloom.functions.ordering import positions, running_sum
from packetloom.operators.epochs import epoch_chained, first_second, numbered_starts

BLOCK = 4096  # epochs of a calendar that one row stands for at first


def frame_accounting(frames: DataFrame) -> DataFrame:
    """Frames per epoch and the running total."""
    per_epoch = frames.groupBy(EPOCH).agg(F.count(F.lit(1)).alias("frames"))
    return running_sum(per_epoch, [], EPOCH, "frames", "total_frames", block_bits=12)


def run_metrics(frames: DataFrame) -> DataFrame:
    """Total frames, number of epochs and average frames per epoch, in one row."""
    per_epoch = frames.groupBy(EPOCH).agg(F.count(F.lit(1)).alias("frames"))
    return per_epoch.agg(
        F.coalesce(F.sum("frames"), F.lit(0)).alias("total_frames"),
        F.count(F.lit(1)).alias("epochs"),
        (F.sum("frames") / F.count(F.lit(1))).alias("avg_frames_per_epoch"),
    )


def epoch_report(result: DataFrame, keys: Sequence[str], value: str, threshold: int) -> DataFrame:
    """Flows whose value is above ``threshold``, numbered per epoch from the largest value down."""
    entries = result.where(F.col(value) > threshold).select(
        EPOCH, flow_key(keys).alias("flow_key"), F.col(value).alias("value")
    )
    return positions(entries, EPOCH, [F.desc("value"), F.asc("flow_key")])


def epoch_calendar(frames: DataFrame, seconds: int, origin: int | Column | None = None) -> DataFrame:
    """Every tumbling epoch up to the last frame, also those without frames: ``epoch_id start_sec end_sec frames total_frames``.

    ``frames`` carry epochs of ``seconds`` from ``origin`` (default: the first frame). The
    calendar is made from the number of the last epoch, in blocks that tasks share.
    """
    origin = first_second(frames) if origin is None else origin
    counted = frames.groupBy(EPOCH).agg(F.count(F.lit(1)).alias("frames"))
    last = frames.agg(F.max(EPOCH).alias("_last")).where("_last IS NOT NULL")
    blocks = last.select("_last", F.explode(F.expr(f"sequence(0L, _last div {BLOCK}L)")).alias("_block")).repartition("_block")
    within = F.expr(f"sequence(_block * {BLOCK}L, least(_last, _block * {BLOCK}L + {BLOCK - 1}L))")
    spine = blocks.select(F.explode(within).alias(EPOCH)).join(counted, EPOCH, "left").fillna(0, ["frames"])
    totals = running_sum(spine, [], EPOCH, "frames", "total_frames", block_bits=12)
    timed = totals.withColumn("start_sec", origin + F.col(EPOCH) * seconds)
    return timed.select(EPOCH, "start_sec", (F.col("start_sec") + seconds).alias("end_sec"), "frames", "total_frames")


def chained_calendar(frames: DataFrame, seconds: int) -> DataFrame:
    """As ``epoch_calendar`` for chained epochs, which all have frames.

    An epoch ends in the second of the frame that closes it; ``end_sec`` is null for
    the last one if none did.
    """
    starts = numbered_starts(frames, seconds).select(EPOCH, F.col("start").alias("start_sec"))
    ends = starts.select((F.col(EPOCH) - 1).alias(EPOCH), F.col("start_sec").alias("end_sec"))
    counted = epoch_chained(frames, seconds).groupBy(EPOCH).agg(F.count(F.lit(1)).alias("frames"))
    totals = running_sum(counted, [], EPOCH, "frames", "total_frames", block_bits=12)
    return totals.join(starts, EPOCH).join(ends, EPOCH, "left").select(EPOCH, "start_sec", "end_sec", "frames", "total_frames")


def full_report(calendar: DataFrame, report: DataFrame) -> DataFrame:
    """The calendar with the lines of an ``epoch_report``; an epoch in which no flow passed has one line without a flow."""
    return calendar.join(report, EPOCH, "left")


def write_report(report: DataFrame, path: str, format: str = "csv") -> None:
    """Replace the report at ``path``: a folder per epoch, rows in report order.

    Rows are range-partitioned, so a large epoch is written by several tasks, whose
    files follow one another in order.
    """
    ordered = report.repartitionByRange(EPOCH, "position").sortWithinPartitions(EPOCH, "position")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(EPOCH).format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
