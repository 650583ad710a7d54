"""Any batch query on a stream, epoch by epoch: late rows kept, outputs exactly once, open epochs flushed.

Each micro-batch is written once to an arrivals table, by epoch. What is known to be
closed is kept in a ledger: one row per batch with the second up to which epochs are
closed. A batch closes the epochs that its newest frame leaves behind; the query then
runs on the arrivals of just these epochs. A frame of an epoch that an earlier batch
closed is late: it stays in the arrivals, apart.

Everything that a batch writes lies in folders of its number and the ledger row comes
last, so a batch that is replayed after a failure replaces what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from packetloom import EPOCH
from packetloom.functions.expressions import floor_div

BATCH, LATE = "batch", "late"


class EpochStream:
    """Runs ``query`` (frames with ``epoch_id`` to rows with ``epoch_id``) over a stream of frames.

    ``epoch_id`` is the second in which the epoch starts. ``seconds`` is the length of
    an epoch and ``origin`` the start of any; an epoch closes when a frame is newer than
    its end by ``delay`` seconds. ``path`` is a folder in shared storage and belongs to
    this stream alone.
    """

    def __init__(self, spark: SparkSession, query: Callable[[DataFrame], DataFrame], path: str, seconds: int, delay: int, origin: int = 0):
        if seconds < 1 or delay < 0:
            raise ValueError("an epoch lasts at least one second, and a delay is not negative")
        self.spark, self.query, self.path = spark, query, path.rstrip("/")
        self.seconds, self.delay, self.offset = seconds, delay, origin % seconds

    def _start_of(self, second):
        return floor_div(second - self.offset, self.seconds) * self.seconds + self.offset

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/{BATCH}=*")
        except AnalysisException as e:
            # no batch yet, or none that brought a row
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def closed_until(self, before: int | None = None) -> int | None:
        """Epochs that start before this second are closed (by batches earlier than ``before``); None if none is."""
        ledger = self._table("ledger")
        if ledger is None:
            return None
        return (ledger if before is None else ledger.where(F.col(BATCH) < before)).agg(F.max("closed_until")).first()[0]

    def process(self, frames: DataFrame, batch: int) -> None:
        """One micro-batch."""
        closed = self.closed_until(before=batch)
        epoch = self._start_of(F.col("ts_sec"))
        late = F.lit(0) if closed is None else F.coalesce(epoch < closed, F.lit(False)).cast("int")
        arrived = f"{self.path}/arrivals/{BATCH}={batch}"
        frames.withColumns({EPOCH: epoch, LATE: late}).write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).partitionBy(LATE, EPOCH).parquet(arrived)
        came = self._table("arrivals")
        newest = None if came is None else came.where(F.col(BATCH) == batch).agg(F.max("ts_sec")).first()[0]
        now = closed if newest is None else self._closed_by(newest, closed)
        if now is not None and now != closed:
            done = self._on_time(closed, now, batch)
            self.query(done).write.mode("overwrite").parquet(f"{self.path}/results/{BATCH}={batch}")
        row = self.spark.range(1).select(F.lit(now).cast("long").alias("closed_until"), F.lit(newest).cast("long").alias("newest"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/{BATCH}={batch}")

    def _closed_by(self, newest: int, closed: int | None) -> int | None:
        until = (newest - self.delay - self.offset) // self.seconds * self.seconds + self.offset
        return until if closed is None else max(until, closed)

    def _on_time(self, start: int | None, end: int | None, upto: int | None = None) -> DataFrame | None:
        """Frames of the epochs from ``start`` up to ``end``: the partitions of no others are read."""
        found = self._table("arrivals")
        if found is None:
            return None
        if upto is not None:
            found = found.where(F.col(BATCH) <= upto)
        found = found.where(F.col(LATE) == 0).withColumn(EPOCH, F.col(EPOCH).cast("long"))
        if start is not None:
            found = found.where(F.col(EPOCH) >= start)
        if end is not None:
            found = found.where(F.col(EPOCH) < end)
        return found.drop(BATCH, LATE)

    def start(self, frames: DataFrame) -> DataStreamWriter:
        """The writer for a stream of frames, not yet started; it keeps its state below ``path``."""
        return frames.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/state")

    def drain(self, frames: DataFrame) -> EpochStream:
        """Process what is there now."""
        self.start(frames).trigger(availableNow=True).start().awaitTermination()
        return self

    def results(self) -> DataFrame | None:
        """Rows of all closed epochs; None if none was closed yet."""
        found = self._table("results")
        return None if found is None else found.drop(BATCH)

    def late_frames(self) -> DataFrame | None:
        """Frames that came after their epoch was closed, with ``epoch_id`` and the ``batch`` that brought them."""
        found = self._table("arrivals")
        return None if found is None else found.where(F.col(LATE) == 1).drop(LATE).withColumn(EPOCH, F.col(EPOCH).cast("long"))

    def flushed(self) -> DataFrame | None:
        """As ``results``, with the epochs that are still open as they stand; None if nothing came at all."""
        still = self._on_time(self.closed_until(), None)
        if still is None:
            return None
        closed, rest = self.results(), self.query(still)
        return rest if closed is None else closed.unionByName(rest)
