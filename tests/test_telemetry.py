"""The composed queries against brute force, and their single-scan forms against the join forms."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom import EPOCH
from packetloom.operators.methods import distinct_by, reduce_by
from packetloom.operators.relational import at_least, epoch_join, filter_eq
from packetloom.plans import telemetry
from packets import as_dicts, by_key, frame, packet, random_packets


@pytest.fixture(scope="module")
def rows():
    # senders and receivers share addresses, so that the joins match
    made = random_packets(1500, seed=5, keys=12)
    return [(*r[:3], "s" + r[3][1:] if r[3] != "d3" else "hot", *r[4:]) for r in made]


@pytest.fixture(scope="module")
def packets(spark, rows):
    return frame(spark, rows).repartition(5).cache()


def sets(rows, group, member):
    out = defaultdict(set)
    for r in as_dicts(rows):
        out[(r[EPOCH], *(r[k] for k in group))].add(tuple(r[k] for k in member))
    return {k: len(v) for k, v in out.items()}


def keep(counts, threshold):
    return {k: v for k, v in counts.items() if v >= threshold}


def test_single_table_queries(packets, rows):
    syn = Counter((r[EPOCH], r["dst_ip"]) for r in as_dicts(rows) if r["tcp_flags"] == 2)
    assert by_key(telemetry.new_tcp_connections(packets, 9), ["dst_ip"], "count") == keep(syn, 9)
    assert by_key(telemetry.superspreader(packets, 12), ["src_ip"], "count") == keep(sets(rows, ["src_ip"], ["dst_ip"]), 12)
    assert by_key(telemetry.port_scan(packets, 15), ["src_ip"], "count") == keep(sets(rows, ["src_ip"], ["dst_port"]), 15)
    brute = keep(sets(rows, ["dst_ip", "total_len"], ["src_ip"]), 2)
    assert by_key(telemetry.ssh_brute_force(packets, 2), ["dst_ip", "total_len"], "count") == brute
    coded = keep(sets(rows, ["dst_ip"], ["src_ip"]), 9)
    assert by_key(telemetry.ssh_brute_force_as_coded(packets, 9), ["dst_ip"], "count") == coded
    flows = Counter()
    for r in as_dicts(rows):
        flows[r[EPOCH], r["dst_ip"], r["src_ip"]] += r["total_len"]
    assert by_key(telemetry.heavy_flows(packets, 5000), ["dst_ip", "src_ip"], "total_len") == keep(flows, 5000)


def flag_counts(rows, left, right):
    a = Counter((r[EPOCH], r["dst_ip"]) for r in as_dicts(rows) if r["tcp_flags"] == left)
    b = Counter((r[EPOCH], r["src_ip"]) for r in as_dicts(rows) if r["tcp_flags"] == right)
    return {k: (a[k], b[k]) for k in a.keys() & b.keys()}


def test_join_queries(packets, rows):
    flood = {k: a + b for k, (a, b) in flag_counts(rows, 2, 17).items()}
    assert by_key(telemetry.syn_flood(packets, 20), ["dst_ip"], "count") == keep(flood, 20)
    open_ = {k for k, (a, b) in flag_counts(rows, 2, 1).items() if a - b >= 1}
    assert {tuple(r) for r in telemetry.completed_flows(packets, 1).collect()} == open_
    # equal flags count a packet on both sides and take the join
    same = {k: a + b for k, (a, b) in flag_counts(rows, 2, 2).items()}
    assert by_key(telemetry.syn_flood(packets, 1, reply_flag=2), ["dst_ip"], "count") == same


def test_single_scan_equals_join(packets):
    left = reduce_by(filter_eq(packets, {"tcp_flags": 2}), ["dst_ip"], 1, out="a")
    right = reduce_by(filter_eq(packets, {"tcp_flags": 17}), ["src_ip"], 1, out="b")
    joined = epoch_join(left, right, ["dst_ip"], ["src_ip"]).select(EPOCH, "dst_ip", (F.col("a") + F.col("b")).alias("count"))
    assert by_key(telemetry.syn_flood(packets, 0), ["dst_ip"], "count") == by_key(joined, ["dst_ip"], "count")

    sent = at_least(reduce_by(packets, ["dst_ip"], "total_len", out="total_len"), "total_len", 20000)
    conns = distinct_by(packets, ["dst_ip", "src_ip", "src_port"])
    counted = at_least(reduce_by(conns, ["dst_ip"], 1), "count", 20)
    composed = epoch_join(sent, counted, ["dst_ip"], ["dst_ip"])
    single = telemetry.slowloris(packets, 20000, 20)
    assert single.columns == composed.columns
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, composed.collect())) != []


def test_null_addresses_never_join(spark):
    df = frame(spark, [packet(1, dst=None, flags=2), packet(2, src=None, flags=17), packet(3, dst=None)])
    assert telemetry.syn_flood(df, 0).count() == 0
    assert [r.dst_ip for r in telemetry.slowloris(df, 0, 0).collect()] == ["b"]


WIDE = {"memory_in_bytes": 4 * 3 * 1_000_003, "depth": 3}


def test_wide_sketches_reproduce_the_exact_queries(packets):
    bloom = {"size": 10_000_019}
    for query, args in (
        (telemetry.new_tcp_connections, (9,)),
        (telemetry.heavy_flows, (5000,)),
        (telemetry.syn_flood, (20,)),
        (telemetry.completed_flows, (1,)),
    ):
        exact, sketched = query(packets, *args), query(packets, *args, method="cms", sketch=WIDE)
        assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, sketched.collect()))
    for query, args in (
        (telemetry.ssh_brute_force, (2,)),
        (telemetry.superspreader, (12,)),
        (telemetry.port_scan, (15,)),
        (telemetry.slowloris, (20000, 20)),
    ):
        exact = query(packets, *args)
        sketched = query(packets, *args, method="cms", sketch=WIDE, distinct_method="bloom", bloom=bloom)
        assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, sketched.collect()))


def test_defaults_run(packets):
    for method in ("cms", "fcm", "beaucoup"):
        assert telemetry.heavy_flows(packets, method=method).count() > 0
    assert telemetry.superspreader(packets, 5, distinct_method="bloom").count() > 0
