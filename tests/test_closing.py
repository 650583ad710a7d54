"""Epoch streams against a loop over batches: closed epochs, late frames, replays and flushes."""

import random
from collections import Counter

import pytest

from packetloom import EPOCH
from packetloom.operators.relational import reduce_exact
from packetloom.plans import telemetry
from packetloom.sources.tables import FRAME_SCHEMA, tcp_only
from packetloom.streaming import windows
from packetloom.streaming.closing import EpochStream
from datetime import datetime, timezone


def frames(spark, rows):
    """rows: (seq, second, source)."""
    made = [(q, datetime.fromtimestamp(t, timezone.utc), t, s, "d", 1, 2, 2, 40, 6, None) for q, t, s in rows]
    return spark.createDataFrame(made, FRAME_SCHEMA)


def count(df):
    return reduce_exact(df, ["src_ip"], 1)


def bag(df):
    return Counter({(r[EPOCH], r.src_ip): r["count"] for r in df.collect()}) if df is not None else Counter()


def plain(batches, seconds, delay, origin):
    closed, on_time, late, newest = None, [], [], None
    for batch in batches:
        start = [(q, (t - origin) // seconds * seconds + origin, s) for q, t, s in batch]
        on_time += [r for r in start if closed is None or r[1] >= closed]
        late += [r for r in start if closed is not None and r[1] < closed]
        if batch:
            newest = max(t for _, t, _ in batch)
            until = (newest - delay - origin) // seconds * seconds + origin
            closed = until if closed is None else max(closed, until)
    per = Counter((e, s) for _, e, s in on_time)
    return Counter({k: v for k, v in per.items() if closed is not None and k[0] < closed}), per, sorted(q for q, _, _ in late)


@pytest.mark.parametrize("seconds,delay,origin", [(10, 0, 0), (10, 25, 3), (7, 3, -2)])
def test_batches_equal_loop(spark, tmp_path, seconds, delay, origin):
    rng = random.Random(delay)
    batches, q = [], 0
    for b in range(5):
        rows = []
        for _ in range(rng.choice([0, 30, 60])):
            rows.append((q, 1000 + 20 * b + rng.randrange(-40, 30), f"s{rng.randrange(3)}"))
            q += 1
        batches.append(rows)
    stream = EpochStream(spark, count, str(tmp_path / "out"), seconds, delay, origin)
    assert stream.results() is None and stream.flushed() is None and stream.late_frames() is None
    for i, batch in enumerate(batches):
        stream.process(frames(spark, batch), i)
    closed, per, late = plain(batches, seconds, delay, origin)
    assert bag(stream.results()) == closed
    assert bag(stream.flushed()) == per
    assert sorted(r.seq for r in stream.late_frames().collect()) == late
    # the last batch once more, as after a failure
    stream.process(frames(spark, batches[-1]), len(batches) - 1)
    assert bag(stream.results()) == closed and bag(stream.flushed()) == per
    assert sorted(r.seq for r in stream.late_frames().collect()) == late


def test_a_batch_that_failed_before_its_ledger_row_is_replayed(spark, tmp_path):
    broken = [True]

    def query(df):
        if broken[0]:
            raise RuntimeError("stop")
        return count(df)

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = EpochStream(spark, query, out, 10, 0)
    frames(spark, [(1, 5, "a"), (2, 12, "a"), (3, 31, "b")]).coalesce(1).write.parquet(folder)
    source = lambda: windows.stream_frames(spark, folder)
    with pytest.raises(Exception, match="stop"):
        stream.drain(source())
    broken[0] = False
    stream.drain(source())
    assert bag(stream.results()) == {(0, "a"): 1, (10, "a"): 1}
    frames(spark, [(4, 6, "a"), (5, 32, "b")]).coalesce(1).write.mode("append").parquet(folder)
    stream.drain(source())
    assert bag(stream.results()) == {(0, "a"): 1, (10, "a"): 1}
    assert bag(stream.flushed()) == {(0, "a"): 1, (10, "a"): 1, (30, "b"): 2}
    assert [r.seq for r in stream.late_frames().collect()] == [4]


def test_flush_reads_open_epochs_only(spark, tmp_path):
    stream = EpochStream(spark, lambda df: telemetry.new_tcp_connections(tcp_only(df), 1), str(tmp_path), 10, 0)
    stream.process(frames(spark, [(i, i, "a") for i in range(100)]), 0)
    still = stream._on_time(stream.closed_until(), None)
    plan = still._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and ">= 90" in plan
    assert still.count() == 10 and len(still.inputFiles()) >= 1
    assert stream.flushed().count() == 10


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        EpochStream(spark, count, "x", 0, 0)
    with pytest.raises(ValueError):
        EpochStream(spark, count, "x", 1, -1)
