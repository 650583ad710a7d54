"""The telemetry queries. Input: packets with ``epoch_id``. Thresholds, flags and methods are parameters.

``method`` / ``sketch`` choose the reduce operator and its parameters,
``distinct_method`` / ``bloom`` the distinct operator and its parameters.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom import EPOCH
from packetloom.functions.expressions import subtract_floor0
from packetloom.operators.methods import distinct_by, reduce_by
from packetloom.operators.relational import at_least, epoch_join, filter_eq

FIN, SYN, FIN_ACK = 1, 2, 17
TCP = 6
Params = Mapping[str, object]


def new_tcp_connections(
    packets: DataFrame, threshold: int = 2, method: str = "exact", sketch: Params | None = None
) -> DataFrame:
    """Hosts that receive many SYN packets."""
    syn = filter_eq(packets, {"tcp_flags": SYN})
    return at_least(reduce_by(syn, ["dst_ip"], 1, method, **(sketch or {})), "count", threshold)


def ssh_brute_force(
    packets: DataFrame,
    threshold: int = 40,
    method: str = "exact",
    sketch: Params | None = None,
    distinct_method: str = "exact",
    bloom: Params | None = None,
) -> DataFrame:
    """Hosts that many sources send packets of one length to."""
    sources = distinct_by(packets, ["dst_ip", "src_ip", "total_len"], distinct_method, **(bloom or {}))
    return at_least(reduce_by(sources, ["dst_ip", "total_len"], 1, method, **(sketch or {})), "count", threshold)


def ssh_brute_force_as_coded(
    packets: DataFrame,
    threshold: int = 40,
    method: str = "exact",
    sketch: Params | None = None,
    distinct_method: str = "exact",
    bloom: Params | None = None,
) -> DataFrame:
    """Variant in which the packet length does not separate groups."""
    sources = distinct_by(packets, ["dst_ip", "src_ip"], distinct_method, **(bloom or {}))
    return at_least(reduce_by(sources, ["dst_ip"], 1, method, **(sketch or {})), "count", threshold)


def superspreader(
    packets: DataFrame,
    threshold: int = 40,
    method: str = "exact",
    sketch: Params | None = None,
    distinct_method: str = "exact",
    bloom: Params | None = None,
) -> DataFrame:
    """Sources that contact many destinations."""
    pairs = distinct_by(packets, ["dst_ip", "src_ip"], distinct_method, **(bloom or {}))
    return at_least(reduce_by(pairs, ["src_ip"], 1, method, **(sketch or {})), "count", threshold)


def port_scan(
    packets: DataFrame,
    threshold: int = 40,
    method: str = "exact",
    sketch: Params | None = None,
    distinct_method: str = "exact",
    bloom: Params | None = None,
) -> DataFrame:
    """Sources that try many destination ports."""
    tcp = filter_eq(packets, {"protocol": TCP})
    ports = distinct_by(tcp, ["src_ip", "dst_port"], distinct_method, **(bloom or {}))
    return at_least(reduce_by(ports, ["src_ip"], 1, method, **(sketch or {})), "count", threshold)


def heavy_flows(
    packets: DataFrame, threshold: int = 1, method: str = "exact", sketch: Params | None = None
) -> DataFrame:
    """Bytes per source and destination."""
    sums = reduce_by(packets, ["dst_ip", "src_ip"], "total_len", method, "total_len", **(sketch or {}))
    return at_least(sums, "total_len", threshold)


def _addressed(packets: DataFrame, address: str) -> DataFrame:
    """Packets that can take part in a join on ``address``.

    Spark would add this test by itself, but only where a sketch is read and not
    where it is filled; the two would then no longer share their key sums.
    """
    return packets.where(F.col(address).isNotNull())


def _flag_counts(
    packets: DataFrame, left_flag: int, right_flag: int, method: str, sketch: Params | None
) -> DataFrame:
    """``left_flag`` packets per destination next to ``right_flag`` packets per source of the same address.

    A packet carries one flag byte, so when the flags differ it counts on one side
    only: the exact form then needs a single scan and shuffle instead of two
    aggregates and a join.
    """
    tcp = filter_eq(packets, {"protocol": TCP})
    if method == "exact" and left_flag != right_flag:
        is_left = F.col("tcp_flags") == left_flag
        address = F.when(is_left, F.col("dst_ip")).otherwise(F.col("src_ip"))
        return (
            tcp.where(F.col("tcp_flags").isin(left_flag, right_flag))
            .select(EPOCH, address.alias("dst_ip"), is_left.cast("long").alias("_left"))
            .transform(_addressed, "dst_ip")
            .groupBy(EPOCH, "dst_ip")
            .agg(F.sum("_left").alias("left_count"), F.sum(1 - F.col("_left")).alias("right_count"))
            .where("left_count > 0 AND right_count > 0")
        )
    params = sketch or {}
    left = _addressed(filter_eq(tcp, {"tcp_flags": left_flag}), "dst_ip")
    right = _addressed(filter_eq(tcp, {"tcp_flags": right_flag}), "src_ip")
    left = reduce_by(left, ["dst_ip"], 1, method, "left_count", **params)
    right = reduce_by(right, ["src_ip"], 1, method, "right_count", **params)
    return epoch_join(left, right, ["dst_ip"], ["src_ip"]).drop("src_ip")


def syn_flood(
    packets: DataFrame,
    threshold: int = 40,
    method: str = "exact",
    sketch: Params | None = None,
    syn_flag: int = SYN,
    reply_flag: int = FIN_ACK,
) -> DataFrame:
    """Hosts whose SYNs received and replies sent add up to many."""
    both = _flag_counts(packets, syn_flag, reply_flag, method, sketch)
    return at_least(
        both.select(EPOCH, "dst_ip", (F.col("left_count") + F.col("right_count")).alias("count")), "count", threshold
    )


def completed_flows(
    packets: DataFrame,
    threshold: int = 1,
    method: str = "exact",
    sketch: Params | None = None,
    syn_flag: int = SYN,
    fin_flag: int = FIN,
) -> DataFrame:
    """Hosts with more connections opened to them than they closed."""
    both = _flag_counts(packets, syn_flag, fin_flag, method, sketch)
    diff = both.select(EPOCH, "dst_ip", subtract_floor0("left_count", "right_count").alias("diff"))
    return at_least(diff, "diff", threshold).select(EPOCH, "dst_ip")


def slowloris(
    packets: DataFrame,
    bytes_threshold: int = 500,
    conns_threshold: int = 5,
    method: str = "exact",
    sketch: Params | None = None,
    distinct_method: str = "exact",
    bloom: Params | None = None,
) -> DataFrame:
    """Hosts with many connections and at least some traffic.

    Exact: bytes are summed per connection first, so one scan yields both figures.
    """
    tcp = filter_eq(packets, {"protocol": TCP})
    connection = ["dst_ip", "src_ip", "src_port"]
    if method == "exact" and distinct_method == "exact":
        both = (
            tcp.groupBy(EPOCH, *connection)
            .agg(F.sum("total_len").alias("total_len"))
            .groupBy(EPOCH, "dst_ip")
            .agg(F.sum("total_len").alias("total_len"), F.count(F.lit(1)).alias("count"))
            .transform(_addressed, "dst_ip")
        )
        return at_least(at_least(both, "total_len", bytes_threshold), "count", conns_threshold)
    params = sketch or {}
    tcp = _addressed(tcp, "dst_ip")
    sent = reduce_by(tcp, ["dst_ip"], "total_len", method, "total_len", **params)
    conns = distinct_by(tcp, connection, distinct_method, **(bloom or {}))
    counted = reduce_by(conns, ["dst_ip"], 1, method, "count", **params)
    return epoch_join(
        at_least(sent, "total_len", bytes_threshold), at_least(counted, "count", conns_threshold), ["dst_ip"], ["dst_ip"]
    )
