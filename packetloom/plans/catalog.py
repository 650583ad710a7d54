"""Every runnable query by name: ``callable(spark, folder) -> DataFrame`` over the tables in ``folder``.

Thresholds and sketch sizes suit the test tables (FIXTURES.md): sketches are small
enough to collide. Each query reads the whole ``events`` table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom import EPOCH
from packetloom.functions import expressions as ex
from packetloom.functions.ordering import positions
from packetloom.functions.storage import scratch_path
from packetloom.operators import counters, coupons, epochs, frequent, membership, relational, report, stats
from packetloom.operators.methods import reduce_by
from packetloom.plans import telemetry
from packetloom.sources import capture
from packetloom.sources.tables import clock_of_events, read_events, read_events_as_frames, tcp_only
from packetloom.streaming import windows
from packetloom.streaming.closing import EpochStream

Query = Callable[[SparkSession, str], DataFrame]

DAY, HOUR, MINUTES = 86400, 3600, 900
SMALL = {"depth": 2, "seed": 42}
CMS = {**SMALL, "memory_in_bytes": 512}  # width 64
TREE = {**SMALL, "width_l1": 256, "width_l2": 32, "width_l3": 4, "threshold_l1": 254, "threshold_l2": 600}
ELASTIC = {**SMALL, "width": 64, "heavy_threshold": 1000}
BLOOM = {"size": 97, "num_hashes": 3, "seed": 42}
COUPON = {"num_rows": 8, "num_coupons": 1024, "d": 3, "seed": 42}
LIGHT = {"width": 64, "seed": 42}
FLOW = ["src_ip", "dst_port"]

_QUERIES: dict[str, Query] = {}


def _packets(run: Callable[[DataFrame], DataFrame]) -> Query:
    """Lift a function of the packets with daily epochs to a query."""
    return lambda spark, folder: run(tcp_only(_frames(spark, folder)))


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return _tumbling(spark, folder, DAY)


def _tumbling(spark: SparkSession, folder: str, seconds: int) -> DataFrame:
    return epochs.epoch_tumbling(read_events_as_frames(spark, folder), seconds, _origin(spark, folder))


def _origin(spark: SparkSession, folder: str):
    return epochs.first_second(clock_of_events(read_events(spark, folder)))


def register(name: str):
    def add(query: Query) -> Query:
        _QUERIES[name] = query
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- sources and accounting -------------------------------------------------------------


@register("packets_view")
def packets_view(spark, folder):
    packets = tcp_only(read_events_as_frames(spark, folder))
    return packets.drop("ts").withColumn("dns_ns_type", F.coalesce("dns_ns_type", F.lit(-1)))


@register("packets_decoded")
def packets_decoded(spark, folder):
    """The events written as capture files and decoded from their bytes, in many small ranges."""
    path = scratch_path(spark, "captures")
    capture.write_pcap(read_events_as_frames(spark, folder), path)
    decoded = capture.frames_from_pcap(spark, path, split_bytes=1 << 20).drop("ts", "dns_ns_type")
    arrived = positions(decoded.withColumn("_all", F.lit(0)), "_all", [F.asc("seq")], "arrival", in_order=True)
    return tcp_only(arrived).select(
        "arrival", "ts_sec", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "total_len", "protocol"
    )


@register("tcp_only")
def tcp_rows(spark, folder):
    return tcp_only(read_events_as_frames(spark, folder)).select("seq", "protocol")


@register("frame_accounting")
def frame_accounting(spark, folder):
    return report.frame_accounting(_frames(spark, folder))


@register("run_metrics")
def run_metrics(spark, folder):
    metrics = report.run_metrics(_frames(spark, folder))
    return metrics.withColumn("avg_frames_per_epoch", F.round("avg_frames_per_epoch", 6))


@register("epoch_report")
def epoch_report(spark, folder):
    packets = tcp_only(_frames(spark, folder))
    counts = relational.reduce_exact(packets, ["dst_ip", "src_ip"], 1)
    return report.epoch_report(counts, ["dst_ip", "src_ip"], "count", 1)


@register("epoch_bounds")
def epoch_bounds(spark, folder):
    return report.epoch_calendar(_tumbling(spark, folder, MINUTES), MINUTES, _origin(spark, folder))


@register("epoch_bounds_chained")
def epoch_bounds_chained(spark, folder):
    calendar = report.chained_calendar(read_events_as_frames(spark, folder), HOUR)
    return calendar.withColumn("end_sec", F.coalesce("end_sec", F.lit(-1)))


@register("epoch_report_full")
def epoch_report_full(spark, folder):
    """Quarters of an hour, in many of which no host receives more than two connections."""
    frames = _tumbling(spark, folder, MINUTES)
    counts = relational.reduce_exact(tcp_only(frames), ["dst_ip"], 1)
    lines = report.epoch_report(counts, ["dst_ip"], "count", 2)
    full = report.full_report(report.epoch_calendar(frames, MINUTES, _origin(spark, folder)), lines)
    return full.withColumns({"flow_key": F.coalesce("flow_key", F.lit("none")), "value": F.coalesce("value", F.lit(0)), "position": F.coalesce("position", F.lit(0))})


# --- epochs -----------------------------------------------------------------------------


@register("epoch_tumbling")
def epoch_tumbling(spark, folder):
    return _tumbling(spark, folder, HOUR).select("seq", EPOCH)


@register("epoch_chained")
def epoch_chained(spark, folder):
    return epochs.epoch_chained(read_events_as_frames(spark, folder), HOUR).select("seq", EPOCH)


@register("last_epoch")
def last_epoch(spark, folder):
    frames = _frames(spark, folder)
    return epochs.last_epoch(relational.reduce_exact(tcp_only(frames), ["dst_ip"], 1), frames)


# --- filters, projections, expressions --------------------------------------------------


_QUERIES["filter_conj"] = _packets(
    lambda p: relational.filter_eq(p, {"tcp_flags": 2, "src_ip": "10.0.0.3", "protocol": 6}).select(
        EPOCH, "seq", "src_ip", "dst_ip", "tcp_flags"
    )
)
_QUERIES["having_ge"] = _packets(
    lambda p: relational.at_least(relational.reduce_exact(p, ["src_ip"], 1), "count", 20)
)
_QUERIES["map_project"] = _packets(lambda p: relational.project(p, "dst_ip", "src_ip"))
_QUERIES["map_const"] = _packets(
    lambda p: relational.project(
        relational.with_constant(relational.with_constant(p, "count", 1), "kind", "tcp"), "dst_ip", "count", "kind"
    )
)
_QUERIES["arith_ops"] = _packets(
    lambda p: p.withColumn("a", F.col("total_len"))
    .withColumn("b", (F.col("src_port") - 1024).cast("long"))
    .select(
        "seq",
        ex.add("a", "b").alias("plus"),
        ex.subtract_floor0("b", "a").alias("minus"),
        ex.multiply("a", "b").alias("times"),
        ex.divide_or_zero("a", "b").alias("quotient"),
    )
)
_QUERIES["flow_key"] = _packets(
    lambda p: relational.reduce_exact(p, ["dst_ip", "dst_port"], 1).select(
        EPOCH, ex.flow_key(["dst_ip", "dst_port"]).alias("flow_key"), "count"
    )
)


# --- joins ------------------------------------------------------------------------------


def _syn_and_fin(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SYN packets per (destination, port) and FIN packets per (source, port)."""
    syn = relational.filter_eq(p, {"tcp_flags": 2})
    fin = relational.filter_eq(p, {"tcp_flags": 1})
    return (
        relational.reduce_exact(syn, ["dst_ip", "dst_port"], 1, "left_count"),
        relational.reduce_exact(fin, ["src_ip", "dst_port"], 1, "right_count"),
    )


def _joined(p: DataFrame) -> DataFrame:
    return relational.epoch_join(*_syn_and_fin(p), ["dst_ip"], ["src_ip"])


_QUERIES["epoch_join"] = _packets(_joined)
_QUERIES["join_left_wins"] = _packets(
    lambda p: relational.epoch_join(
        relational.reduce_exact(relational.filter_eq(p, {"tcp_flags": 2}), ["dst_ip"], 1),
        relational.reduce_exact(relational.filter_eq(p, {"tcp_flags": 1}), ["src_ip"], 1),
        ["dst_ip"],
        ["src_ip"],
    )
)
_QUERIES["join_one_per_left"] = _packets(
    lambda p: relational.epoch_join_first(
        *(side.withColumnRenamed("dst_port", port) for side, port in zip(_syn_and_fin(p), ["port", "right_port"])),
        ["dst_ip"],
        ["src_ip"],
        ["right_port"],
    )
)
_QUERIES["map_join"] = _packets(
    lambda p: _joined(p).select(
        EPOCH,
        "dst_ip",
        "dst_port",
        ex.add("left_count", "right_count").alias("total"),
        ex.subtract_floor0("left_count", "right_count").alias("diff"),
    )
)
_QUERIES["post_join_filter"] = _packets(lambda p: relational.at_least(_joined(p), "right_count", 2))


# --- distinct ---------------------------------------------------------------------------


_QUERIES["distinct_exact"] = _packets(
    lambda p: relational.distinct_exact(p, ["dst_ip", "src_ip"], first_row=True).select(
        EPOCH, "seq", "dst_ip", "src_ip", "dst_port", "tcp_flags", "total_len"
    )
)
_QUERIES["distinct_bloom"] = _packets(
    lambda p: membership.distinct_bloom(p, ["dst_ip", "src_ip", "total_len"], **BLOOM)
)
_QUERIES["distinct_bloom_rows"] = _packets(
    lambda p: membership.distinct_bloom(p, ["dst_ip", "src_ip"], first_row=True, **BLOOM).select(
        EPOCH, "seq", "dst_ip", "src_ip", "dst_port", "tcp_flags", "total_len"
    )
)
_QUERIES["bloom_semi_join"] = _packets(
    lambda p: membership.bloom_semi_join(
        relational.filter_eq(p, {"tcp_flags": 1}),
        relational.filter_eq(p, {"tcp_flags": 2}),
        ["dst_ip", "dst_port"],
        ["dst_ip", "dst_port"],
        **BLOOM,
    ).select(EPOCH, "seq", "dst_ip", "dst_port")
)


# --- reduce -----------------------------------------------------------------------------


_QUERIES["reduce_exact"] = _packets(lambda p: reduce_by(p, FLOW, "total_len", out="total"))
_QUERIES["reduce_running"] = _packets(
    lambda p: relational.reduce_running(p, ["src_ip"], "total_len", "total").select(EPOCH, "seq", "src_ip", "total")
)
_QUERIES["reduce_last_row"] = _packets(
    lambda p: relational.reduce_last_row(p, ["src_ip"], 1).select(
        EPOCH, "seq", "src_ip", "count", "dst_ip", "dst_port", "total_len"
    )
)
_QUERIES["reduce_cms"] = _packets(lambda p: reduce_by(p, FLOW, "total_len", "cms", "total", **CMS))
_QUERIES["reduce_cms_arrival"] = _packets(
    lambda p: reduce_by(p, FLOW, "total_len", "cms", "total", mode="arrival", **CMS)
)
_QUERIES["reduce_fcm"] = _packets(lambda p: reduce_by(p, FLOW, "total_len", "fcm", "total", **TREE))
_QUERIES["reduce_fcm_heavy"] = _packets(
    lambda p: reduce_by(p, FLOW, "total_len", "fcm", "total", heavy_threshold=1000, **TREE)
)
_QUERIES["reduce_fcm_arrival"] = _packets(
    lambda p: reduce_by(p, FLOW, "total_len", "fcm", "total", mode="arrival", **TREE)
)
_QUERIES["reduce_fcm_l1"] = _packets(
    lambda p: reduce_by(p, FLOW, "total_len", "fcm_l1", "total", width_l1=64, **SMALL)
)
_QUERIES["reduce_elastic"] = _packets(lambda p: reduce_by(p, FLOW, "total_len", "elastic", "total", **ELASTIC))
_QUERIES["reduce_beaucoup"] = _packets(
    lambda p: reduce_by(p, FLOW, 1, "beaucoup", "estimate", max_coupons_per_packet=2, **COUPON)
)


@register("beaucoup_merged")
def beaucoup_merged(spark, folder):
    """Bitmaps of half days, united to days."""
    halves = coupons.coupon_bitmaps(tcp_only(_tumbling(spark, folder, DAY // 2)), FLOW, max_coupons_per_packet=2, **COUPON)
    days = coupons.unite_bitmaps(halves, ex.floor_div(EPOCH, 2))
    return coupons.estimate_from(days, tcp_only(_frames(spark, folder)), FLOW, "estimate", **COUPON)


_QUERIES["coupon_distinct"] = _packets(
    lambda p: coupons.coupon_distinct(p, ["src_ip"], ["dst_ip", "dst_port"], **COUPON)
)
_QUERIES["beaucoup_contains"] = _packets(
    # many rows, so that some of them stay empty
    lambda p: coupons.beaucoup_contains(
        coupons.coupon_table(
            relational.filter_eq(p, {"tcp_flags": 2}), ["dst_ip", "src_ip"], num_rows=64, num_coupons=1024, d=2
        ),
        p,
        ["dst_ip", "src_ip"],
        num_rows=64,
        d=2,
    )
)
_QUERIES["sketch_probe"] = _packets(
    # probes are the flows of FIN packets, the sketch holds SYN packets: many are absent
    lambda p: counters.point_estimate(
        counters.build_counters(relational.filter_eq(p, {"tcp_flags": 2}), FLOW, 1, width=64, **SMALL),
        relational.filter_eq(p, {"tcp_flags": 1}),
        FLOW,
        width=64,
        **SMALL,
    )
)


# --- statistics -------------------------------------------------------------------------


def _light(p: DataFrame) -> DataFrame:
    return stats.light_count(p, FLOW, 1, **LIGHT)


_QUERIES["cardinality_linear"] = _packets(
    lambda p: stats.cardinality_linear(p, FLOW, 1, width=256, **SMALL).withColumn(
        "cardinality", F.round("cardinality", 4)
    )
)
_QUERIES["light_count"] = _packets(lambda p: stats.light_count(p, FLOW, "total_len", **LIGHT))
_QUERIES["light_max"] = _packets(lambda p: stats.light_max(p, FLOW, "total_len", **LIGHT))
_QUERIES["light_cardinality"] = _packets(
    lambda p: stats.light_cardinality(stats.light_count(p, ["src_ip", "tcp_flags"], 1, **LIGHT), 64).withColumn(
        "cardinality", F.round("cardinality", 4)
    )
)
_QUERIES["flow_size_distribution"] = _packets(lambda p: stats.flow_size_distribution(_light(p), 64))
_QUERIES["flow_entropy"] = _packets(
    lambda p: stats.flow_entropy(_light(p)).select(
        EPOCH, "total", F.round("size_log_size", 6).alias("size_log_size"), F.round("entropy", 6).alias("entropy")
    )
)
_QUERIES["light_fold"] = _packets(
    lambda p: stats.light_query(stats.light_fold(_light(p), 64, 4), p, FLOW, ratio=4, **LIGHT)
)
_QUERIES["heavy_hitters"] = _packets(
    lambda p: stats.heavy_hitters(p, ["dst_ip", "src_ip"], "total_len", 10, "total_len")
)
_QUERIES["heavy_hitters_approx"] = _packets(lambda p: stats.heavy_hitters_approx(p, ["src_ip"], 16))


# fewer counters than there are addresses
_QUERIES["frequent_keys"] = _packets(lambda p: frequent.frequent_keys(p, ["src_ip"], "total_len", 14, "total_len"))


# --- telemetry queries ------------------------------------------------------------------


_QUERIES["q1_new_tcp"] = _packets(lambda p: telemetry.new_tcp_connections(p, 2))
_QUERIES["q2_ssh_brute"] = _packets(lambda p: telemetry.ssh_brute_force(p, 2))
_QUERIES["q2_as_coded"] = _packets(lambda p: telemetry.ssh_brute_force_as_coded(p, 10))
_QUERIES["q3_superspreader"] = _packets(lambda p: telemetry.superspreader(p, 10))
_QUERIES["q4_port_scan"] = _packets(lambda p: telemetry.port_scan(p, 10))
_QUERIES["q5_heavy_flows"] = _packets(lambda p: telemetry.heavy_flows(p, 1))
_QUERIES["q6_syn_flood"] = _packets(lambda p: telemetry.syn_flood(p, 8))
_QUERIES["q7_completed_flow"] = _packets(lambda p: telemetry.completed_flows(p, 1))
_QUERIES["q8_slowloris"] = _packets(lambda p: telemetry.slowloris(p, 500, 5))

_QUERIES["q1_cms"] = _packets(lambda p: telemetry.new_tcp_connections(p, 2, "cms", CMS))
_QUERIES["q1_fcm"] = _packets(lambda p: telemetry.new_tcp_connections(p, 2, "fcm", TREE))
_QUERIES["q1_beaucoup"] = _packets(lambda p: telemetry.new_tcp_connections(p, 2, "beaucoup", COUPON))
_QUERIES["q2_bloom_cms"] = _packets(
    lambda p: telemetry.ssh_brute_force(p, 2, "cms", CMS, distinct_method="bloom", bloom=BLOOM)
)
_QUERIES["q3_bloom_cms"] = _packets(
    lambda p: telemetry.superspreader(p, 5, "cms", CMS, distinct_method="bloom", bloom=BLOOM)
)
_QUERIES["q4_bloom"] = _packets(lambda p: telemetry.port_scan(p, 5, distinct_method="bloom", bloom=BLOOM))
_QUERIES["q5_fcm"] = _packets(lambda p: telemetry.heavy_flows(p, 1, "fcm", TREE))
_QUERIES["q6_cms"] = _packets(lambda p: telemetry.syn_flood(p, 8, "cms", CMS))
_QUERIES["q7_cms"] = _packets(lambda p: telemetry.completed_flows(p, 1, "cms", CMS))
_QUERIES["q8_bloom_cms"] = _packets(
    lambda p: telemetry.slowloris(p, 500, 3, "cms", CMS, distinct_method="bloom", bloom=BLOOM)
)


# --- streams ----------------------------------------------------------------------------


@register("stream_q1")
def stream_q1(spark, folder):
    frames = windows.stream_events_as_frames(spark, folder)
    return windows.run_to_table(windows.new_tcp_connections(frames, DAY, 2, delay="0 seconds"), "stream_q1")


@register("stream_q3")
def stream_q3(spark, folder):
    frames = windows.stream_events_as_frames(spark, folder)
    return windows.run_to_table(windows.superspreader(frames, DAY, 10, delay="0 seconds"), "stream_q3")


@register("stream_q6")
def stream_q6(spark, folder):
    frames = windows.stream_events_as_frames(spark, folder)
    return windows.run_to_table(windows.syn_flood(frames, DAY, 8, delay="0 seconds"), "stream_q6")


@register("stream_q1_flushed")
def stream_q1_flushed(spark, folder):
    frames = read_events_as_frames(spark, folder)
    return windows.with_open_epochs(stream_q1(spark, folder), frames, windows.new_tcp_connections, DAY, threshold=2)


def _closing(run: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str) -> EpochStream:
    """The events as a stream through a query on packets; calendar days close one after another."""
    stream = EpochStream(spark, lambda frames: run(tcp_only(frames)), scratch_path(spark, "closing"), DAY, delay=0)
    return stream.drain(windows.stream_events_as_frames(spark, folder))


def _flushed(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: _closing(run, spark, folder).flushed().withColumnRenamed(EPOCH, "epoch_start")


_QUERIES["stream_q2_flushed"] = _flushed(lambda p: telemetry.ssh_brute_force(p, 2))
_QUERIES["stream_q3_flushed"] = _flushed(lambda p: telemetry.superspreader(p, 10))
_QUERIES["stream_q4_bloom"] = _flushed(lambda p: telemetry.port_scan(p, 5, distinct_method="bloom", bloom=BLOOM))
_QUERIES["stream_q5_fcm"] = _flushed(lambda p: telemetry.heavy_flows(p, 1, "fcm", TREE))
_QUERIES["stream_q6_flushed"] = _flushed(lambda p: telemetry.syn_flood(p, 8))
_QUERIES["stream_q7_flushed"] = _flushed(lambda p: telemetry.completed_flows(p, 1))
_QUERIES["stream_q8_flushed"] = _flushed(lambda p: telemetry.slowloris(p, 500, 5))


@register("stream_report")
def stream_report(spark, folder):
    """Report lines of the closed days, each day's written once as it closes."""

    def lines(packets: DataFrame) -> DataFrame:
        counts = relational.reduce_exact(packets, ["dst_ip", "src_ip"], 1)
        return report.epoch_report(counts, ["dst_ip", "src_ip"], "count", 1)

    return _closing(lines, spark, folder).results().withColumnRenamed(EPOCH, "epoch_start")


@register("stream_late")
def stream_late(spark, folder):
    """One event in ten comes when all others have come: those of closed days are late, and kept apart."""
    events = read_events(spark, folder)
    inbox = scratch_path(spark, "inbox")
    stream = EpochStream(spark, lambda frames: relational.reduce_exact(frames, ["src_ip"], 1), scratch_path(spark, "closing"), DAY, delay=0)
    for some in (F.col("event_id") % 10 != 9, F.col("event_id") % 10 == 9):
        events.where(some).write.mode("append").parquet(f"{inbox}/events.parquet")
        stream.drain(windows.stream_events_as_frames(spark, inbox))
    late = relational.reduce_exact(stream.late_frames(), ["src_ip"], 1, "late")
    counted = stream.flushed().join(late, [EPOCH, "src_ip"], "full").fillna(0, ["count", "late"])
    return counted.withColumnRenamed(EPOCH, "epoch_start")
