"""Windowed telemetry on Structured Streaming.

An epoch is a ``window``; results carry ``epoch_start`` (Unix seconds). The
functions also run on batch frames, which is how open windows are flushed.
Append mode emits a window once the watermark has passed its end, so the last
window of a finite input stays open until ``with_open_epochs`` adds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import EPOCH
from packetloom.functions.expressions import floor_div
from packetloom.functions.storage import scratch_path
from packetloom.operators.report import epoch_report
from packetloom.sources.tables import EVENTS_SCHEMA, FRAME_SCHEMA, frames_from_events, tcp_only

FIN, SYN, FIN_ACK = 1, 2, 17


def stream_events_as_frames(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the ``events`` table (a file or a folder of files) as frames.

    With ``max_files_per_trigger`` files should arrive in time order, or the
    watermark delay must cover the disorder between triggers.
    """
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # the glob lets a stream, which expects folders, also take a single file
    return frames_from_events(reader.parquet(f"{folder}/events.parque[t]"))


def stream_frames(spark: SparkSession, folder: str, format: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream frames that are stored in the layout of ``frames``, in any format that Spark streams from folders."""
    reader = spark.readStream.format(format).schema(FRAME_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def windowed(frames: DataFrame, seconds: int, origin: int = 0, delay: str | None = None) -> DataFrame:
    """Add the epoch window. ``origin`` is any epoch start. Rows of a stream later than ``delay``
    behind the newest are dropped once their window is closed, so a stream must name it."""
    if frames.isStreaming and delay is None:
        raise ValueError("a stream needs a delay, after which late rows are dropped")
    window = F.window("ts", f"{seconds} seconds", f"{seconds} seconds", f"{origin % seconds} seconds")
    watermarked = frames.withWatermark("ts", delay) if frames.isStreaming else frames
    return watermarked.withColumn("window", window)


def _start():
    return F.unix_seconds("window.start").alias("epoch_start")


def new_tcp_connections(frames: DataFrame, seconds: int, threshold: int = 2, **time) -> DataFrame:
    """SYN packets per destination and window."""
    syn = tcp_only(windowed(frames, seconds, **time)).where(F.col("tcp_flags") == SYN)
    counts = syn.groupBy("window", "dst_ip").agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") >= threshold).select(_start(), "dst_ip", "count")


def superspreader(frames: DataFrame, seconds: int, threshold: int = 40, **time) -> DataFrame:
    """Distinct destinations per source and window: two chained windowed aggregates."""
    pairs = tcp_only(windowed(frames, seconds, **time)).groupBy("window", "dst_ip", "src_ip").agg(F.count(F.lit(1)))
    again = F.window("window", f"{seconds} seconds", f"{seconds} seconds", f"{time.get('origin', 0) % seconds} seconds")
    counts = pairs.groupBy(again.alias("window"), "src_ip").agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") >= threshold).select(_start(), "src_ip", "count")


def window_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join of two windowed aggregates on window and key; the left window stays.

    Both close a window in the same batch of a stream, so their rows meet in one
    group: one state for each task instead of the four of a join of streams.
    """

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        # a join leaves out null keys before the watermark sees their rows
        keyed = df.where(F.col("window").isNotNull() & F.col(key).isNotNull())
        return keyed.select("window", F.col(key).alias("_key"), F.struct(*[c for c in df.columns if c != "window"]).alias(name))

    both = side(left, left_key, "_left").unionByName(side(right, right_key, "_right"), allowMissingColumns=True)
    met = both.groupBy("window", "_key").agg(F.collect_list("_left").alias("_left"), F.collect_list("_right").alias("_right"))
    return met.select("window", F.inline("_left"), "_right").select("*", F.inline("_right")).drop("_right")


def syn_flood(frames: DataFrame, seconds: int, threshold: int = 40, **time) -> DataFrame:
    """SYNs received plus replies sent per host and window."""

    def per_address(flag: int, address: str, out: str) -> DataFrame:
        some = tcp_only(windowed(frames, seconds, **time)).where(F.col("tcp_flags") == flag)
        return some.groupBy("window", address).agg(F.count(F.lit(1)).alias(out))

    left, right = per_address(SYN, "dst_ip", "left_count"), per_address(FIN_ACK, "src_ip", "right_count")
    both = window_join(left, right, "dst_ip", "src_ip")
    total = both.withColumn("count", F.col("left_count") + F.col("right_count"))
    return total.where(F.col("count") >= threshold).select(_start(), "dst_ip", "count")


def run_to_table(result: DataFrame, label: str) -> DataFrame:
    """Drain the stream's available input into a table in the shared folder; return it as a batch.

    Table and state go to a new path, so every run is a fresh query.
    """
    spark = result.sparkSession
    path = scratch_path(spark, label)
    query = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start(f"{path}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/rows")


def with_open_epochs(
    emitted: DataFrame, frames: DataFrame, query: Callable[..., DataFrame], seconds: int, origin: int = 0, **params
) -> DataFrame:
    """``emitted`` plus a batch run of ``query`` over the frames after the last emitted window."""
    offset = origin % seconds
    start = floor_div(F.col("ts_sec") - offset, seconds) * seconds + offset
    closed = emitted.agg(F.max("epoch_start")).scalar()
    still_open = frames.where(closed.isNull() | (start > closed))
    return emitted.unionByName(query(still_open, seconds, origin=origin, **params))


def report_sink(result: DataFrame, key: str, value: str, threshold: int, path: str, format: str = "parquet"):
    """Write an epoch report as each window closes; returns the configured writer, not yet started.

    A closed window arrives whole in one micro-batch. A batch replayed after a
    failure overwrites the folders of its own windows only.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        report = epoch_report(batch.withColumnRenamed("epoch_start", EPOCH), [key], value, threshold)
        (
            report.repartitionByRange(EPOCH, "position")
            .sortWithinPartitions(EPOCH, "position")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(EPOCH)
            .format(format)
            .save(path)
        )

    return result.writeStream.outputMode("append").foreachBatch(write)
