"""What the physical plans must look like for large inputs."""

import re

import pytest

import __spark_entry__ as contract
from packetloom.operators import counters, membership, stats
from packetloom.plans import catalog, telemetry
from packetloom.sources.tables import FRAME_COLUMNS, read_events_as_frames, read_frames
from packets import frame, random_packets

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_cross_joins(spark, no_broadcast):
    for name, query in catalog.queries().items():
        if not name.startswith("stream"):
            assert not re.search("CartesianProduct|NestedLoopJoin", plan(query(spark, FOLDER))), name


@pytest.mark.parametrize("name", ["distinct_bloom", "distinct_bloom_rows"])
def test_bloom_distinct_has_no_join(spark, no_broadcast, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert "Join" not in text
    assert len(re.findall(r"FileScan parquet \[[^]]*props", text)) == 1


@pytest.mark.parametrize("name", ["q6_syn_flood", "q7_completed_flow", "q8_slowloris"])
def test_join_queries_scan_once(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert len(re.findall(r"FileScan parquet \[[^]]*props", text)) == 1
    assert "Join" not in text


@pytest.mark.parametrize(
    "name,scans",
    [("q1_cms", 1), ("q5_fcm", 1), ("q4_bloom", 1), ("q3_bloom_cms", 1), ("q2_bloom_cms", 1), ("q6_cms", 2), ("q8_bloom_cms", 2)],
)
def test_sketched_queries_read_each_input_once(spark, name, scans):
    made = contract.queries()[name](spark, FOLDER)
    made.collect()
    final = plan(made)
    final = final[: final.rindex("\n+- == Initial Plan ==")]
    # stages that really read the event payload, not those that reuse another stage
    assert len(re.findall(r"FileScan parquet \[[^]]*props", final)) == scans


def test_sketch_tables_share_the_key_sums(spark, no_broadcast):
    df = frame(spark, random_packets(200))
    keys = ["src_ip", "dst_ip"]
    for made in (
        counters.reduce_cms(df, keys, "total_len"),
        counters.reduce_fcm(df, keys, "total_len"),
    ):
        made.collect()
        assert "ReusedExchange" in plan(made).split("== Initial Plan ==")[0]


def test_broadcast_lookup_keeps_the_partitioning(spark):
    """With a small sketch table the second grouping by key needs no shuffle of its own."""
    made = counters.reduce_cms(frame(spark, random_packets(200)), ["src_ip"], 1, memory_in_bytes=256)
    made.collect()
    final = plan(made).split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final
    assert len(re.findall(r"- Exchange hashpartitioning\(epoch_id#\d+L, src_ip", final)) == 1


def test_hot_key_of_a_row_level_join_is_split(spark, no_broadcast):
    """Adaptive execution splits the rows of one key that outweighs all others."""
    rows = random_packets(20000, hot=0.6, keys=200, epochs=1)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = frame(spark, rows).repartition(8).cache()
        kept = membership.bloom_semi_join(df, df, ["src_ip"], ["src_ip"])
        assert kept.count() == len(rows)
        done = kept.select("seq", "total_len")
        done.collect()
        assert "skew=true" in plan(done).split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_narrow_tables_are_salted(spark, no_broadcast):
    df = frame(spark, random_packets(200))
    assert "_salt" in plan(counters.reduce_cms(df, ["src_ip"], 1, memory_in_bytes=256))
    assert "_salt" not in plan(counters.reduce_cms(df, ["src_ip"], 1))
    assert "_salt" in plan(stats.light_query(stats.light_count(df, ["src_ip"], width=64), df, ["src_ip"], width=64))


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(stats.heavy_hitters(frame(spark, random_packets(50)), ["src_ip"], 1, 5))
    assert "WindowGroupLimit" in text and "Partial" in text
    # beyond Spark's limit for cutting early, slices of an epoch are still ranked apart
    assert "_slice" in plan(stats.heavy_hitters(frame(spark, random_packets(50)), ["src_ip"], 1, 5000))


def test_stored_frames_push_filters_down(spark, tmp_path):
    path = str(tmp_path / "frames")
    read_events_as_frames(spark, FOLDER).write.parquet(path)
    frames = read_frames(spark, path)
    assert tuple(frames.columns) == FRAME_COLUMNS
    found = telemetry.new_tcp_connections(frames.selectExpr("*", "ts_sec div 86400 AS epoch_id"))
    text = plan(found)
    assert "EqualTo(tcp_flags,2)" in text
    assert "total_len" not in text.split("FileScan")[1].split("Batched")[0]


def test_frames_in_other_formats(spark, tmp_path):
    frames = read_events_as_frames(spark, FOLDER)
    for format in ("orc", "json", "csv"):
        frames.write.format(format).save(str(tmp_path / format))
        back = read_frames(spark, str(tmp_path / format), format)
        # text formats write times in milliseconds
        assert sorted(map(str, back.drop("ts").collect())) == sorted(map(str, frames.drop("ts").collect()))
