"""Cutting time into epochs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom import EPOCH, SEQ
from packetloom.functions import chains
from packetloom.functions.expressions import floor_div
from packetloom.functions.ordering import total_before
from packetloom.functions.skew import salted_lookup
from packetloom.functions.storage import cut_lineage

# one task of epoch_chained walks a span of so many epoch lengths, but of no more seconds than that
SPAN_EPOCHS = 64
SPAN_SECONDS = 1 << 21
BUCKET_SALTS = 16


def first_second(frames: DataFrame) -> Column:
    """Second of the first frame, as a scalar subquery that reads only the time column."""
    return frames.select("ts_sec").agg(F.min("ts_sec")).scalar()


def epoch_tumbling(frames: DataFrame, seconds: int, origin: int | Column | None = None) -> DataFrame:
    """Fixed slices of ``seconds``, the first one starting at the first frame.

    ``origin`` is the second to start from, if it is known or found more cheaply
    than with ``first_second(frames)``.
    """
    if seconds < 1:
        raise ValueError("an epoch lasts at least one second")
    if origin is None:
        origin = first_second(frames)
    # one plain column first: the subquery then stands in the plan once
    since = frames.withColumn(EPOCH, F.col("ts_sec") - origin)
    return since.withColumn(EPOCH, floor_div(EPOCH, seconds))


def _span_seconds(seconds: int) -> int:
    """Length of the spans of time that one task looks at: many epochs, as long as they cover at most ``SPAN_SECONDS``."""
    return min(seconds * SPAN_EPOCHS, max(SPAN_SECONDS, SPAN_EPOCHS))


def chained_starts(frames: DataFrame, seconds: int) -> DataFrame:
    """``start, start_seq``: start second of every chained epoch, with the ``seq`` of the frame that opens it.

    The next start is the first occupied second at least ``seconds`` later, so
    starts form a chain. It is followed in parallel: time is cut into spans. (1)
    Each span works out, for every second at which the chain could enter it, the
    time from which on the next span is looked for. A span that is longer than an
    epoch can only be entered near its beginning, so few seconds are left. (2) The
    first occupied second from each of these times on makes entries point to
    entries, and the ones on the chain are found by doubling. (3) Each span lists
    its starts from its true entry. No task sees more than the occupied seconds of
    one span, however many frames there are and however long an epoch is.
    """
    length = _span_seconds(seconds)
    occupied = cut_lineage(frames.groupBy("ts_sec").agg(F.min(SEQ).alias("first_seq")))
    spans = occupied.withColumn("_span", floor_div("ts_sec", length))

    def possible_entries(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows["ts_sec"].to_numpy())
        here = np.arange(len(t))
        hop = np.searchsorted(t, t + seconds)
        last = np.where(hop < len(t), hop, here)
        for _ in range(length.bit_length()):
            last = last[last]
        begin = int(rows["_span"].iloc[0]) * length
        entries = min(int(np.searchsorted(t, begin + seconds - 1)) + 1, len(t))
        return pd.DataFrame({"start": t[:entries], "value": t[last[:entries]] + seconds})

    def list_starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts_sec")
        t = rows["ts_sec"].to_numpy()
        picked, at = [], int(np.searchsorted(t, rows["entry"].iloc[0]))
        while at < len(t):
            picked.append(at)
            at = int(np.searchsorted(t, t[at] + seconds))
        return rows.iloc[picked][["ts_sec", "first_seq"]].rename(columns={"ts_sec": "start", "first_seq": "start_seq"})

    entries = cut_lineage(spans.groupBy("_span").applyInPandas(possible_entries, "start long, value long"))
    following = chains.first_at_least(entries.select("value"), occupied.select(F.col("ts_sec").alias("value")))
    steps = cut_lineage(entries.join(following, "value").select("start", F.col("found").alias("next")))
    root = occupied.agg(F.min("ts_sec").alias("start")).where("start IS NOT NULL")
    on_chain = chains.reached(steps, root).select(floor_div("start", length).alias("_span"), F.col("start").alias("entry"))
    return spans.join(on_chain, "_span").groupBy("_span").applyInPandas(list_starts, "start long, start_seq long")


def numbered_starts(frames: DataFrame, seconds: int) -> DataFrame:
    """``epoch_id, start, start_seq`` of every chained epoch."""
    starts = cut_lineage(chained_starts(frames, seconds))
    counted = starts.withColumn("_one", F.lit(1).cast("long"))
    return total_before(counted, "start", "_one", EPOCH).drop("_one")


def epoch_chained(frames: DataFrame, seconds: int) -> DataFrame:
    """Epochs whose start is chained through the data.

    A frame at least ``seconds`` after the running epoch's start still belongs to
    that epoch and closes it; the next epoch starts at that frame's second.
    Needs unique ``seq`` and ``ts_sec`` that never decreases with it.

    Starts are at least ``seconds`` apart, so an aligned bucket of that length holds
    at most one, and the epoch before it reaches into the bucket as well. Both are
    told to the bucket's frames by an equi-join, with one bucket's frames split.
    """
    if seconds < 1:
        raise ValueError("an epoch lasts at least one second")
    starts = cut_lineage(numbered_starts(frames, seconds).withColumn("_bucket", floor_div("start", seconds)))
    occupied = frames.select(floor_div("ts_sec", seconds).alias("_bucket")).distinct()
    # the last epoch that starts in an earlier bucket; starts and buckets are few against frames
    asked = occupied.select(F.col("_bucket").alias("value"))
    # seen from behind, the start before a bucket is the first one at least as far
    behind = chains.first_at_least(
        asked.select((1 - F.col("value")).alias("value")), starts.select((-F.col("_bucket")).alias("value"))
    ).select((1 - F.col("value")).alias("_bucket"), (-F.col("found")).alias("_earlier"))
    epochs = starts.select(F.col("_bucket").alias("_earlier"), F.col(EPOCH).alias("_before"))
    lookup = (
        behind.join(epochs, "_earlier", "left")
        .join(starts, "_bucket", "left")
        .select("_bucket", "start", "start_seq", F.col(EPOCH).alias("_own"), F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    keyed = frames.withColumn("_bucket", floor_div("ts_sec", seconds))
    joined = salted_lookup(keyed, cut_lineage(lookup), ["_bucket"], [SEQ], BUCKET_SALTS, "inner")
    opened = (F.col("ts_sec") > F.col("start")) | (
        (F.col("ts_sec") == F.col("start")) & (F.col(SEQ) > F.col("start_seq"))
    )
    # the frame that opens an epoch still belongs to the one before; the very first one to epoch 0
    epoch = F.when(F.coalesce(opened, F.lit(False)), F.col("_own")).otherwise(F.col("_before"))
    return joined.withColumn(EPOCH, epoch).drop("_bucket", "start", "start_seq", "_before", "_own")


def last_epoch(df: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Rows of the last, possibly unfinished epoch of ``frames`` (default: of ``df`` itself)."""
    latest = (df if frames is None else frames).agg(F.max(EPOCH)).scalar()
    return df.where(F.col(EPOCH) == latest)
