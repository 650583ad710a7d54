"""Streams against batch: closed windows are equal, late rows are dropped, open windows can be flushed."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.sources.tables import EVENTS_SCHEMA, read_events_as_frames
from packetloom.streaming import windows

FOLDER = "/root/testdata/sf0.001"
DAY = 86400


@pytest.fixture(scope="module")
def four_files(spark, tmp_path_factory):
    """The events in four files, in time order."""
    folder = tmp_path_factory.mktemp("ordered")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    total = events.count()
    for i in range(4):
        part = events.orderBy("event_id").offset(i * total // 4).limit(total // 4)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return str(folder)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("query,threshold", [(windows.new_tcp_connections, 1), (windows.superspreader, 2), (windows.syn_flood, 2)])
def test_stream_equals_batch_on_closed_windows(spark, query, threshold):
    batch = rows(query(read_events_as_frames(spark, FOLDER), DAY, threshold))
    last = max(r[0] for r in batch)
    stream = windows.run_to_table(query(windows.stream_events_as_frames(spark, FOLDER), DAY, threshold, delay="0 seconds"), "closed")
    assert rows(stream) == [r for r in batch if r[0] < last]


def test_window_join_is_an_inner_join(spark):
    """Several rows of a window and key on one side or both, null keys, and a name on both sides."""
    table = "t INT, host STRING, n INT"
    one = [(0, "a", 1), (0, "a", 2), (0, "b", 3), (1, "a", 4), (1, None, 5), (2, "c", 6)]
    other = [(0, "a", 10), (0, "a", 20), (1, "a", 30), (1, "b", 40), (1, None, 50), (3, "c", 60)]

    def sides(key):
        for name, values in (("host", one), (key, other)):
            df = spark.createDataFrame(values, table).withColumn("window", F.window(F.timestamp_seconds(F.col("t") * 10), "10 seconds"))
            yield df.select("window", F.col("host").alias(name), F.when(F.col("n") != 2, F.col("n")).alias("n"))

    left, right = sides("peer")
    got = windows.window_join(left, right, "host", "peer")
    assert got.columns == ["window", "host", "n", "peer", "n"]
    expected = [(t * 10, h, None if n == 2 else n, h, m) for t, h, n in one for u, p, m in other if (t, h) == (u, p) and h]
    rows = [(int(r[0].start.timestamp()), *r[1:]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_syn_flood_on_a_stream_has_one_state_for_the_join(spark, tmp_path):
    result = windows.syn_flood(windows.stream_events_as_frames(spark, FOLDER), DAY, 2, delay="0 seconds")
    writer = result.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    query = writer.trigger(availableNow=True).start(str(tmp_path / "rows"))
    query.awaitTermination()
    states = [o.operatorName for o in query.lastProgress.stateOperators]
    assert states == ["stateStoreSave"] * 3
    # the rows of a closed window are sent once for its counts, not again to meet
    assert query._jsq.explainInternal(False).count("Exchange hashpartitioning") == 2


def test_clock_of_a_join_is_the_slower_side(spark, tmp_path):
    """A window closes when packets of both kinds that can meet have passed its end; one without an address does not count."""
    start = datetime(2024, 1, 1)
    kinds = [(1, "signup", 1, 1), (2, "purchase", 1, 1), (11, "signup", 1, 1), (12, "purchase", 1, 1), (25, "signup", 1, 1), (35, "purchase", None, 1), (36, "signup", 1, None)]
    made = [(i, start + timedelta(seconds=t), user, kind, 1.0, None if k is None else f'{{"k": {k}}}') for i, (t, kind, user, k) in enumerate(kinds)]
    spark.createDataFrame(made, EVENTS_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    result = windows.syn_flood(windows.stream_events_as_frames(spark, str(tmp_path)), 10, 1, delay="0 seconds")
    base = 1704067200  # 2024-01-01 UTC
    assert rows(windows.run_to_table(result, "slower")) == [(base, "10.0.0.1", 2)]


def test_several_files_per_stream(spark, four_files):
    batch = rows(windows.new_tcp_connections(read_events_as_frames(spark, four_files), DAY, 1))
    source = windows.stream_events_as_frames(spark, four_files, max_files_per_trigger=1)
    stream = rows(windows.run_to_table(windows.new_tcp_connections(source, DAY, 1, delay="40 days"), "many"))
    # a watermark far behind closes nothing
    assert stream == []
    source = windows.stream_events_as_frames(spark, four_files, max_files_per_trigger=4)
    stream = rows(windows.run_to_table(windows.new_tcp_connections(source, DAY, 1, delay="0 seconds"), "many"))
    assert stream == [r for r in batch if r[0] < max(b[0] for b in batch)]


def test_flush_adds_the_open_window(spark):
    frames = read_events_as_frames(spark, FOLDER)
    for query, threshold in ((windows.new_tcp_connections, 1), (windows.superspreader, 2)):
        emitted = windows.run_to_table(query(windows.stream_events_as_frames(spark, FOLDER), DAY, threshold, delay="0 seconds"), "flush")
        whole = windows.with_open_epochs(emitted, frames, query, DAY, threshold=threshold)
        assert rows(whole) == rows(query(frames, DAY, threshold))


def test_flush_when_nothing_was_emitted(spark):
    frames = read_events_as_frames(spark, FOLDER)
    none = windows.new_tcp_connections(frames.where("false"), DAY, 1)
    whole = windows.with_open_epochs(none, frames, windows.new_tcp_connections, DAY, threshold=1)
    assert rows(whole) == rows(windows.new_tcp_connections(frames, DAY, 1))


def events(spark, *seconds):
    start = datetime(2024, 1, 1)
    made = [(i, start + timedelta(seconds=s), 1, "signup", 1.0, '{"k": 1}') for i, s in enumerate(seconds)]
    return spark.createDataFrame(made, EVENTS_SCHEMA).coalesce(1)


def test_late_rows_are_dropped_and_origin_shifts_windows(spark, tmp_path):
    results = {}
    for delay in ("0 seconds", "1000 seconds"):
        table = tmp_path / delay.replace(" ", "_")
        path = f"{table}/events.parquet"
        checkpoint, out = f"{table}/state", f"{table}/out"
        # three runs of one query: the second input brings rows of a window closed by the first
        for batch in ((5, 12, 25, 47), (13, 14, 48), (2000,)):
            events(spark, *batch).write.mode("append").parquet(path)
            stream = windows.new_tcp_connections(
                windows.stream_events_as_frames(spark, str(table)), 10, 1, origin=5, delay=delay
            )
            query = (
                stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start(out)
            )
            query.awaitTermination()
        got = spark.read.parquet(out).collect()
        base = 1704067200  # 2024-01-01 UTC
        results[delay] = {r.epoch_start - base: r["count"] for r in got}
    assert results["0 seconds"] == {5: 2, 25: 1, 45: 2}
    assert results["1000 seconds"] == {5: 4, 25: 1, 45: 2}


def test_report_sink_writes_closed_windows_once(spark, tmp_path):
    source = windows.stream_events_as_frames(spark, FOLDER)
    with pytest.raises(ValueError, match="delay"):
        windows.new_tcp_connections(source, DAY, 1)
    result = windows.new_tcp_connections(source, DAY, 1, delay="0 seconds")
    out = str(tmp_path / "report")
    for _ in range(2):  # the second run finds nothing new
        writer = windows.report_sink(result, "dst_ip", "count", 0, out)
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(out)
    frames = read_events_as_frames(spark, FOLDER)
    batch = windows.new_tcp_connections(frames, DAY, 1)
    last = batch.agg(F.max("epoch_start")).first()[0]
    expected = batch.where(F.col("epoch_start") < last).selectExpr("epoch_start", "concat('dst_ip: ', dst_ip)", "count")
    assert rows(written.select("epoch_id", "flow_key", "value")) == rows(expected)
    firsts = written.where("position = 1").select("epoch_id", "value")
    tops = expected.groupBy("epoch_start").agg(F.max("count"))
    assert rows(firsts) == rows(tops)
