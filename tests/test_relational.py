"""Filter, projection, expressions, distinct, reduce and joins on small tables with edge cases."""

from collections import defaultdict

import pytest

from packetloom import EPOCH
from packetloom.functions import expressions as ex
from packetloom.operators import relational as rel
from packets import as_dicts, by_key, frame, packet, random_packets


def test_arithmetic_edges(spark):
    rows = [(7, 2), (2, 7), (5, 0), (0, 3), (0, 0), (None, 1), (1, None)]
    df = spark.createDataFrame(rows, "a long, b long").select(
        "a",
        "b",
        ex.add("a", "b").alias("plus"),
        ex.subtract_floor0("a", "b").alias("minus"),
        ex.multiply("a", "b").alias("times"),
        ex.divide_or_zero("a", "b").alias("quotient"),
    )
    assert [tuple(r)[2:] for r in df.collect()] == [
        (9, 5, 14, 3),
        (9, 0, 14, 0),
        (5, 5, 0, 0),
        (3, 0, 0, 0),
        (0, 0, 0, 0),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_floor_div_rounds_down(spark):
    df = spark.createDataFrame([(-7,), (-6,), (-1,), (0,), (5,), (6,)], "a long")
    assert [r[0] for r in df.select(ex.floor_div("a", 6)).collect()] == [-2, -1, -1, 0, 0, 1]


def test_flow_key_label(spark):
    df = frame(spark, [packet(1, src=None, dport=80)]).select(ex.flow_key(["src_ip", "dst_port"]))
    assert df.first()[0] == "src_ip: <missing>, dst_port: 80"


def test_filter_compares_whole_flag_byte(spark):
    df = frame(spark, [packet(1, flags=2), packet(2, flags=18), packet(3, flags=2, src="x"), packet(4, flags=None)])
    assert [r.seq for r in rel.filter_eq(df, {"tcp_flags": 2, "src_ip": "a"}).collect()] == [1]
    assert rel.filter_eq(df, {}).count() == 4
    with pytest.raises(ValueError, match="cannot filter"):
        rel.filter_eq(df, {"total_len": 40})


def test_unknown_field_is_an_error(spark):
    with pytest.raises(Exception, match="nope"):
        rel.project(frame(spark, [packet(1)]), "nope").collect()


def test_empty_input(spark):
    empty = frame(spark, [])
    assert rel.reduce_exact(empty, ["src_ip"], 1).count() == 0
    assert rel.distinct_exact(empty, ["src_ip"], first_row=True).count() == 0
    assert rel.reduce_running(empty, ["src_ip"], 1).count() == 0
    assert rel.epoch_join(empty, empty, ["dst_ip"], ["src_ip"]).count() == 0


def test_state_starts_empty_in_each_epoch(spark):
    df = frame(spark, [packet(1, 0), packet(2, 0), packet(3, 1)])
    assert by_key(rel.reduce_exact(df, ["src_ip"], 1), ["src_ip"], "count") == {(0, "a"): 2, (1, "a"): 1}
    assert rel.distinct_exact(df, ["src_ip"]).count() == 2


def test_null_keys_group_and_missing_values_are_left_out(spark):
    rows = [packet(1, src=None, length=5), packet(2, src=None, length=6), packet(3, src="a", length=None)]
    assert by_key(rel.reduce_exact(frame(spark, rows), ["src_ip"], "total_len", "n"), ["src_ip"], "n") == {
        (0, None): 11
    }


def test_first_and_last_rows(spark):
    rows = [packet(3, length=3, dport=33), packet(1, length=1, dport=None), packet(2, length=2, dport=22)]
    first = rel.distinct_exact(frame(spark, rows), ["src_ip"], first_row=True).first()
    assert (first.seq, first.total_len, first.dst_port) == (1, 1, None)
    last = rel.reduce_last_row(frame(spark, rows), ["src_ip"], "total_len", "bytes").first()
    assert (last.seq, last["bytes"], last.total_len, last.dst_port) == (3, 6, 3, 33)


@pytest.mark.parametrize("block_bits", [1, 4, 20])
def test_running_sum_in_blocks(spark, block_bits):
    rows = random_packets(300)
    expected, sums = {}, defaultdict(int)
    for r in as_dicts(rows):
        sums[r[EPOCH], r["src_ip"]] += r["total_len"]
        expected[r["seq"]] = sums[r[EPOCH], r["src_ip"]]
    df = frame(spark, rows[::-1]).repartition(5)
    got = rel.reduce_running(df, ["src_ip"], "total_len", "n", block_bits=block_bits)
    assert {r.seq: r.n for r in got.collect()} == expected
    assert set(got.columns) == {*df.columns, "n"}


def test_running_sum_with_null_key(spark):
    df = frame(spark, [packet(1, src=None), packet(2, src=None), packet(9, src="a")])
    got = rel.reduce_running(df, ["src_ip"], 1, block_bits=1)
    assert {r.seq: r["count"] for r in got.collect()} == {1: 1, 2: 2, 9: 1}


def test_join_within_epoch_left_wins(spark):
    left = spark.createDataFrame([(0, "x", 1), (1, "x", 2), (1, "y", 3), (1, None, 4)], "epoch_id long, dst_ip string, n long")
    right = spark.createDataFrame([(1, "x", 9), (2, "y", 9), (1, None, 9)], "epoch_id long, src_ip string, n long")
    rows = rel.epoch_join(left, right, ["dst_ip"], ["src_ip"]).collect()
    assert [r.asDict() for r in rows] == [{"epoch_id": 1, "dst_ip": "x", "n": 2, "src_ip": "x"}]
    with pytest.raises(ValueError):
        rel.epoch_join(left, right, ["dst_ip"], [])


def test_join_on_several_keys(spark):
    left = spark.createDataFrame([(0, "x", 1), (0, "x", 2)], "epoch_id long, k string, p long")
    right = spark.createDataFrame([(0, "x", 2, "hit"), (0, "y", 1, "no")], "epoch_id long, k string, q long, m string")
    assert [r.m for r in rel.epoch_join(left, right, ["k", "p"], ["k", "q"]).collect()] == ["hit"]


def test_many_right_rows_keep_the_first(spark):
    left = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "epoch_id long, dst_ip string, n long")
    right = spark.createDataFrame([(0, "x", i, i * 10) for i in range(50, 0, -1)], "epoch_id long, src_ip string, p long, v long")
    rows = rel.epoch_join_first(left, right, ["dst_ip"], ["src_ip"], ["p"]).collect()
    assert [(r.dst_ip, r.p, r.v) for r in rows] == [("x", 1, 10)]


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0, 4), (0, 5), (0, None)], "epoch_id long, n long")
    assert [r.n for r in rel.at_least(df, "n", 5).collect()] == [5]


def test_filter_reaches_the_scan_and_columns_are_pruned(spark, tmp_path):
    from packetloom.plans import telemetry

    frame(spark, random_packets(50)).write.parquet(str(tmp_path / "p"))
    plan = telemetry.new_tcp_connections(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().toString()
    assert "EqualTo(tcp_flags,2)" in plan
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("total_len" not in line and "src_port" not in line for line in scans)
