"""Epochs against a loop over frames; report, accounting and sink."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom import EPOCH
from packetloom.functions.ordering import positions
from packetloom.operators import epochs, relational, report
from packets import frame, packet


def chained(seconds, length):
    """Epoch of each frame: process the frame, then close the epoch once it spans ``length``."""
    start, epoch, out = None, 0, []
    for t in seconds:
        start = t if start is None else start
        out.append(epoch)
        if t - start >= length:
            epoch, start = epoch + 1, t
    return out


def clock(seed, n, gap, jump):
    rng = random.Random(seed)
    t, out = rng.randrange(-500, 500), []
    for _ in range(n):
        t += rng.randrange(gap) if rng.random() < 0.97 else rng.randrange(jump)
        out.append(t)
    return out


@pytest.mark.parametrize(
    "seed,n,gap,jump,length,span",
    [(1, 400, 3, 50, 7, 64), (2, 400, 2, 400, 5, 2), (3, 300, 1, 2, 1, 4), (4, 400, 9, 10, 30, 1), (5, 200, 4, 9000, 11, 3)],
)
def test_chained_equals_loop(spark, monkeypatch, seed, n, gap, jump, length, span):
    monkeypatch.setattr(epochs, "SPAN_EPOCHS", span)
    seconds = clock(seed, n, gap, jump)
    df = frame(spark, [packet(10 * i, ts=t) for i, t in enumerate(seconds)]).drop(EPOCH).repartition(4)
    got = [r[EPOCH] for r in epochs.epoch_chained(df, length).orderBy("seq").collect()]
    assert got == chained(seconds, length)


DAY = 86400


@pytest.mark.parametrize("days,gap,span", [(90, DAY // 3, 1 << 21), (90, 40 * DAY, DAY), (400, DAY, 1 << 20)])
def test_long_chained_epochs_in_short_spans(spark, monkeypatch, days, gap, span):
    """Epochs that cover many spans, with spans in which nothing happens."""
    monkeypatch.setattr(epochs, "SPAN_SECONDS", span)
    assert epochs._span_seconds(days * DAY) <= span
    seconds = clock(days, 500, gap, 300 * DAY)
    df = frame(spark, [packet(3 * i, ts=t) for i, t in enumerate(seconds)]).drop(EPOCH).repartition(4)
    got = [r[EPOCH] for r in epochs.epoch_chained(df, days * DAY).orderBy("seq").collect()]
    assert got == chained(seconds, days * DAY)
    starts = epochs.numbered_starts(df, days * DAY).orderBy(EPOCH).collect()
    assert [s[EPOCH] for s in starts] == [*range(len(starts))]
    assert max(got) in (len(starts) - 1, len(starts) - 2)


def test_one_frame_and_long_epochs(spark):
    one = frame(spark, [packet(1, ts=50)]).drop(EPOCH)
    assert [r[EPOCH] for r in epochs.epoch_chained(one, 10).collect()] == [0]
    assert [r[EPOCH] for r in epochs.epoch_tumbling(one, 10).collect()] == [0]
    few = frame(spark, [packet(i, ts=50 + i) for i in range(5)]).drop(EPOCH)
    assert {r[EPOCH] for r in epochs.epoch_tumbling(few, 1000).collect()} == {0}
    assert {r[EPOCH] for r in epochs.epoch_chained(few, 1000).collect()} == {0}


def test_empty_frames(spark):
    none = frame(spark, []).drop(EPOCH)
    assert epochs.epoch_tumbling(none, 10).count() == 0
    assert epochs.epoch_chained(none, 10).count() == 0


def test_epoch_needs_a_second(spark):
    for cut in (epochs.epoch_tumbling, epochs.epoch_chained):
        with pytest.raises(ValueError):
            cut(frame(spark, []), 0)


def test_origin(spark):
    df = frame(spark, [packet(1, ts=95), packet(2, ts=105)]).drop(EPOCH)
    assert [r[EPOCH] for r in epochs.epoch_tumbling(df, 10, origin=100).orderBy("seq").collect()] == [-1, 0]


def test_last_epoch(spark):
    df = frame(spark, [packet(1, 0), packet(2, 3), packet(3, 3)])
    assert [r.seq for r in epochs.last_epoch(df).orderBy("seq").collect()] == [2, 3]


def result(spark, rows):
    return spark.createDataFrame(rows, "epoch_id long, dst_ip string, count long")


def test_report_order_ties_and_strict_threshold(spark):
    rows = [(0, "b", 5), (0, "a", 5), (0, "c", 9), (0, "d", 2), (1, "a", 3), (1, "z", 2)]
    got = report.epoch_report(result(spark, rows), ["dst_ip"], "count", 2).collect()
    assert sorted((r[EPOCH], r.position, r.flow_key, r.value) for r in got) == [
        (0, 1, "dst_ip: c", 9),
        (0, 2, "dst_ip: a", 5),
        (0, 3, "dst_ip: b", 5),
        (1, 1, "dst_ip: a", 3),
    ]
    assert report.epoch_report(result(spark, rows), ["dst_ip"], "count", 100).count() == 0


def test_positions_over_many_slices(spark):
    rng = random.Random(3)
    # one epoch holds most entries, so it spreads over several sorted slices
    rows = [(0 if rng.random() < 0.8 else 1, f"k{i:04}", rng.randrange(6)) for i in range(2000)]
    got = report.epoch_report(result(spark, rows).repartition(7), ["dst_ip"], "count", 0).collect()
    for epoch in (0, 1):
        expected = sorted(((-v, f"dst_ip: {k}") for e, k, v in rows if e == epoch and v > 0))
        mine = sorted((r.position, -r.value, r.flow_key) for r in got if r[EPOCH] == epoch)
        assert mine == [(i + 1, v, k) for i, (v, k) in enumerate(expected)]


@pytest.mark.parametrize("in_order", [False, True])
def test_positions_do_not_shuffle_what_is_sorted(spark, in_order):
    rows = spark.range(0, 1000, 1, 7).select(F.expr("CASE WHEN id >= 300 THEN id DIV 900 END AS part"), F.col("id").alias("seq"))
    before = rows.withColumn("was_in", F.spark_partition_id())
    numbered = positions(before, "part", [F.asc("seq")], in_order=in_order).withColumn("is_in", F.spark_partition_id())
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = sorted(numbered.collect(), key=lambda r: r.seq)
    starts = {None: 0, 0: 300, 1: 900}
    assert [(r.seq, r.position) for r in got] == [(i, i - starts[r.part] + 1) for i, r in enumerate(got)]
    assert not in_order or all(r.was_in == r.is_in for r in got)


def test_positions_with_more_parts_than_can_be_broadcast(spark):
    rows = spark.range(0, 500, 1, 5).select((F.col("id") % 100).alias("part"), F.col("id").alias("seq"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100b")
    try:
        numbered = positions(rows, "part", [F.desc("seq")])
        assert "BroadcastHashJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.seq, r.position) for r in numbered.collect()) == [(i, 5 - i // 100) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_accounting_and_metrics(spark):
    df = frame(spark, [packet(i, e) for i, e in enumerate([0, 0, 0, 2, 5000, 5000])])
    got = report.frame_accounting(df).orderBy(EPOCH).collect()
    assert [(r[EPOCH], r.frames, r.total_frames) for r in got] == [(0, 3, 3), (2, 1, 4), (5000, 2, 6)]
    assert tuple(report.run_metrics(df).first()) == (6, 3, 2.0)
    assert tuple(report.run_metrics(frame(spark, [])).first()) == (0, 0, None)


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_sink_replaces_and_keeps_order(spark, tmp_path, format):
    path = str(tmp_path / "report")
    for values in ([7, 1, 9], [4, 8]):
        rows = [(e, f"k{v}", v) for e in (0, 1) for v in values]
        report.write_report(report.epoch_report(result(spark, rows), ["dst_ip"], "count", 2), path, format)
    reader = spark.read.option("header", True).option("inferSchema", True)
    back = reader.format(format).load(path).orderBy(EPOCH, "position").collect()
    assert [(r[EPOCH], r.position, r.value) for r in back] == [(0, 1, 8), (0, 2, 4), (1, 1, 8), (1, 2, 4)]


def test_zoneless_time_is_utc_in_any_session_zone(spark):
    from packetloom.sources.tables import EVENTS_SCHEMA, frames_from_events
    from datetime import datetime

    moment = datetime(2024, 3, 10, 2, 30, 15, 250000)
    rows = [(1, moment, 5, "signup", 3.7, '{"k": 19}')]
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = frames_from_events(spark.createDataFrame(rows, EVENTS_SCHEMA)).selectExpr("*", "unix_micros(ts) AS us").first()
            assert (row.ts_sec, row.us) == (1710037815, 1710037815250000)
            assert (row.tcp_flags, row.protocol, row.dst_port, row.total_len) == (2, 17, 19, 43)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_calendar_has_epochs_without_frames(spark):
    rows = [packet(i, ts=t, src=f"s{i % 2}") for i, t in enumerate((100, 101, 155, 158, 159))]
    frames = epochs.epoch_tumbling(frame(spark, rows).drop(EPOCH), 10)
    calendar = report.epoch_calendar(frames, 10)
    got = [tuple(r) for r in calendar.orderBy(EPOCH).collect()]
    assert got == [(0, 100, 110, 2, 2), *[(e, 100 + 10 * e, 110 + 10 * e, 0, 2) for e in range(1, 5)], (5, 150, 160, 3, 5)]
    lines = report.epoch_report(relational.reduce_exact(frames, ["src_ip"], 1), ["src_ip"], "count", 1)
    full = report.full_report(calendar, lines).orderBy(EPOCH).collect()
    assert [(r[EPOCH], r.flow_key, r.value) for r in full] == [*[(e, None, None) for e in range(5)], (5, "src_ip: s0", 2)]
    assert report.epoch_calendar(frames.where("false"), 10).count() == 0


def test_chained_calendar(spark):
    frames = frame(spark, [packet(i, ts=t) for i, t in enumerate((100, 105, 130, 131, 145, 150))]).drop(EPOCH)
    got = [tuple(r) for r in report.chained_calendar(frames, 10).orderBy(EPOCH).collect()]
    # the frame that closes an epoch counts in it
    assert got == [(0, 100, 130, 3, 3), (1, 130, 145, 2, 5), (2, 145, None, 1, 6)]
    assert report.chained_calendar(frames.where("false"), 10).count() == 0
