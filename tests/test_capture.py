"""Capture decoding from bytes made here, whole and cut into small ranges."""

import random
import struct

import pytest

from packetloom.operators import epochs, report
from packetloom.plans import telemetry
from packetloom.sources.capture import capture_ranges, frames_from_pcap, packets_from_pcap


def ethernet(payload, kind=0x0800):
    return bytes(12) + struct.pack(">H", kind) + payload


def ipv4(payload, protocol=6, src="10.0.0.1", dst="192.168.255.2", options=b"", total=None):
    ihl = 5 + len(options) // 4
    total = ihl * 4 + len(payload) if total is None else total
    octets = lambda a: bytes(int(x) for x in a.split("."))
    head = struct.pack(">BBHHHBBH", 0x40 | ihl, 0, total, 0, 0, 64, protocol, 0) + octets(src) + octets(dst)
    return head + options + payload


def tcp(src_port=1234, dst_port=80, flags=2, data=b""):
    return struct.pack(">HHIIBBHHH", src_port, dst_port, 1, 2, 0x50, flags, 100, 0, 0) + data


def capture(frames, order="<", nanos=False, link=1):
    """frames: (sec, fraction, bytes) or (sec, fraction, bytes, kept length)."""
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for sec, fraction, data, *kept in frames:
        captured = data[: kept[0]] if kept else data
        out += struct.pack(order + "IIII", sec, fraction, len(captured), len(data)) + captured
    return out


MIXED = [
    (100, 5, ethernet(ipv4(tcp(flags=2)))),
    (100, 6, ethernet(ipv4(bytes(8), protocol=17))),
    (101, 0, ethernet(bytes(60), kind=0x86DD)),
    (102, 0, ethernet(ipv4(tcp(flags=18, data=b"hello"), options=bytes(8)))),
    (103, 0, ethernet(ipv4(tcp())), 40),  # TCP header cut off
    (104, 0, b"\x01\x02"),
    (105, 0, ethernet(ipv4(tcp(), total=30))),  # IPv4 length leaves no room for TCP
]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("nanos", [False, True])
def test_decodes_layers(spark, tmp_path, order, nanos):
    (tmp_path / "a.pcap").write_bytes(capture(MIXED, order, nanos))
    rows = frames_from_pcap(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.ts_sec for r in rows] == [100, 100, 101, 102, 103, 104, 105]
    assert [r.protocol for r in rows] == [6, 17, None, 6, None, None, None]
    first, fourth = rows[0], rows[3]
    assert (first.src_ip, first.dst_ip, first.src_port, first.dst_port) == ("10.0.0.1", "192.168.255.2", 1234, 80)
    assert (first.tcp_flags, first.total_len) == (2, 40)
    assert (fourth.tcp_flags, fourth.total_len, fourth.dst_port) == (18, 53, 80)
    assert first.ts.microsecond == (0 if nanos else 5)
    assert packets_from_pcap(spark, str(tmp_path)).count() == 2


def test_truncated_tail_ends_the_capture(spark, tmp_path):
    whole = capture(MIXED[:2])
    (tmp_path / "a.pcap").write_bytes(whole + struct.pack("<IIII", 1, 1, 500, 500) + b"short")
    assert frames_from_pcap(spark, str(tmp_path)).count() == 2
    (tmp_path / "a.pcap").write_bytes(whole + b"\x00" * 7)
    assert frames_from_pcap(spark, str(tmp_path)).count() == 2


def test_empty_capture_and_bad_files(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([]))
    assert frames_from_pcap(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.pcap").write_bytes(b"not a capture, but long enough to hold a header")
    with pytest.raises(Exception, match="not a classic capture"):
        frames_from_pcap(spark, str(tmp_path)).count()
    assert frames_from_pcap(spark, str(tmp_path), glob="a.*").count() == 0


def nested_record(rng):
    """A payload that itself looks like a run of capture records, to mislead guessing."""
    inner = b"".join(struct.pack("<IIII", 7, 7, 20, 20) + bytes(20) for _ in range(rng.randrange(20, 40)))
    return bytes(rng.randrange(0, 9)) + inner


@pytest.mark.parametrize("split", [300, 2000])
def test_small_ranges_equal_one_range(spark, tmp_path, split):
    rng = random.Random(split)
    for name in ("a", "b"):
        frames = []
        for i in range(40):
            data = nested_record(rng) if rng.random() < 0.3 else rng.randbytes(rng.randrange(0, 200))
            frames.append((100 + i, i, ethernet(ipv4(tcp(src_port=i, data=data)))))
        (tmp_path / f"{name}.pcap").write_bytes(capture(frames))
    whole = frames_from_pcap(spark, str(tmp_path)).orderBy("seq").collect()
    assert len(whole) == 80
    assert [r.src_port for r in whole] == [*range(40), *range(40)]
    assert frames_from_pcap(spark, str(tmp_path), split_bytes=split).orderBy("seq").collect() == whole


def test_damage_in_the_middle_ends_the_capture(spark, tmp_path):
    good = capture([(1, i, ethernet(ipv4(tcp(src_port=i)))) for i in range(50)])
    more = capture([(2, i, ethernet(ipv4(tcp(src_port=i)))) for i in range(50)])[24:]
    broken = good + struct.pack("<IIII", 1, 1, 1 << 30, 1 << 30) + more
    (tmp_path / "a.pcap").write_bytes(broken)
    for split in (1 << 20, 500):
        assert frames_from_pcap(spark, str(tmp_path), split_bytes=split).count() == 50


def test_a_record_that_is_too_long_ends_the_capture_in_every_split(spark, tmp_path):
    good = capture([(1, i, ethernet(ipv4(tcp(src_port=i)))) for i in range(50)])
    more = capture([(2, i, ethernet(ipv4(tcp(src_port=i % 60_000, data=bytes(900))))) for i in range(400)])[24:]
    broken = good + struct.pack("<IIII", 1, 1, 270_000, 270_000) + more
    (tmp_path / "a.pcap").write_bytes(broken)
    for split in (40_000, 1 << 27):
        assert [r.src_port for r in frames_from_pcap(spark, str(tmp_path), split_bytes=split).orderBy("seq").collect()] == [*range(50)]
        reads = [r.stop - r.start for r in capture_ranges(spark, str(tmp_path), split).where("start < hi and start < stop").collect()]
        assert sum(reads) == len(good) - 24


def test_query_on_a_capture(spark, tmp_path):
    frames = [(100 + i // 4, 0, ethernet(ipv4(tcp(src_port=i, flags=2)))) for i in range(40)]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    loaded = epochs.epoch_tumbling(frames_from_pcap(spark, str(tmp_path)), 5)
    found = telemetry.new_tcp_connections(loaded, 2).orderBy("epoch_id").collect()
    assert [(r.epoch_id, r["count"]) for r in found] == [(0, 20), (1, 20)]
    assert report.run_metrics(loaded).first().avg_frames_per_epoch == 20


def trap(ranges, split):
    """A capture in which a run of likely records and then a bad length lie at the start of every range but the first."""
    bait = b"".join(struct.pack("<IIII", 7, 7, 20, 20) + bytes(20) for _ in range(20)) + struct.pack("<IIII", 7, 7, 1 << 30, 1 << 30)
    out, n = capture([]), 0
    for r in range(1, ranges):
        # fill up to shortly before the range, then one record over its start
        while r * split - len(out) > 300:
            out += capture([(1, n, ethernet(ipv4(tcp(src_port=n % 60_000))))])[24:]
            n += 1
        data = ethernet(ipv4(tcp(src_port=n % 60_000)))
        data += bytes(r * split - len(out) - 16 - len(data)) + bait + bytes(30)
        out += capture([(2, n, data)])[24:]
        n += 1
    return out, n


def test_traps_at_every_range_take_few_rounds(spark, tmp_path, monkeypatch):
    from packetloom.functions import chains
    from packetloom.sources import capture as module

    split = 3000
    data, n = trap(24, split)
    (tmp_path / "a.pcap").write_bytes(data)
    (tmp_path / "b.pcap").write_bytes(capture([(1, i, ethernet(ipv4(tcp(src_port=i)))) for i in range(200)]))
    rounds = {"reads": 0, "joins": 0}

    def counting(name, call):
        def counted(*a):
            rounds[name] += 1
            return call(*a)

        return counted

    monkeypatch.setattr(module, "_spread", counting("reads", module._spread))
    monkeypatch.setattr(chains, "cut_lineage", counting("joins", chains.cut_lineage))
    got = [r.src_port for r in frames_from_pcap(spark, str(tmp_path), split_bytes=split).orderBy("seq").collect()]
    assert got == [*range(n), *range(200)]
    assert rounds["reads"] <= 3  # guess, maps, decode
    assert rounds["joins"] // 2 <= (24).bit_length() + 2
    assert [r.src_port for r in frames_from_pcap(spark, str(tmp_path)).orderBy("seq").collect()] == got


@pytest.mark.parametrize("split", [500, 4096, 1 << 20])
def test_traps_in_every_split(spark, tmp_path, split):
    data, n = trap(9, 3000)
    (tmp_path / "a.pcap").write_bytes(data)
    assert [r.src_port for r in frames_from_pcap(spark, str(tmp_path), split_bytes=split).orderBy("seq").collect()] == [*range(n)]


def test_frames_lie_in_order_of_seq(spark, tmp_path):
    data, n = trap(9, 3000)
    (tmp_path / "a.pcap").write_bytes(data)
    (tmp_path / "c.pcap").write_bytes(capture([(1, i, ethernet(ipv4(tcp(src_port=i)))) for i in range(200)]))
    frames = frames_from_pcap(spark, str(tmp_path), split_bytes=500)
    assert [r.src_port for r in frames.collect()] == [*range(n), *range(200)]


def test_exits_equal_following_each_offset():
    from packetloom.sources import formats

    layout = formats.Classic("<", 1_000_000)
    for seed in range(12):
        rng = random.Random(seed)
        data = b"".join(
            rng.choice([bytes(rng.randrange(60)), struct.pack("<IIII", 1, 1, rng.randrange(40), 40), rng.randbytes(rng.randrange(30))])
            for _ in range(60)
        )
        limit = rng.randrange(len(data) + 1)
        offsets, place, ends, over = formats.exits(layout, data, 0, limit)
        for at, p in zip(offsets.tolist(), place.tolist()):
            _, end, ended = formats.hop(layout, data, at, limit)
            assert (end, ended) == ((at, True) if p < 0 else (int(ends[p]), bool(over[p])))


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def block_capture(frames, order="<", resolution=None, links=(1,)):
    """frames: (ticks, bytes) or (ticks, bytes, kind)."""
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    for link in links:
        option = b"" if resolution is None else struct.pack(order + "HHB3xHH", 9, 1, resolution, 0, 0)
        out += block(1, struct.pack(order + "HHI", link, 0, 100) + option, order)
    for i, (ticks, data, *kind) in enumerate(frames):
        kind = kind[0] if kind else 6
        if kind == 3:
            body = struct.pack(order + "I", len(data)) + data[:100]
        else:
            who = struct.pack(order + "HH", 0, 0) if kind == 2 else struct.pack(order + "I", i % len(links))
            body = who + struct.pack(order + "IIII", ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data
        out += block(kind, body, order)
        if i % 7 == 3:
            out += block(5, bytes(20), order)  # statistics
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("resolution,per_second", [(None, 10**6), (9, 10**9), (0x80 | 10, 1 << 10)])
def test_blocks_decode_as_records_do(spark, tmp_path, order, resolution, per_second):
    plain = [(100 + i // 5, 0, ethernet(ipv4(tcp(src_port=i, flags=i % 32), protocol=6 if i % 3 else 17))) for i in range(80)]
    (tmp_path / "a.pcap").write_bytes(capture(plain))
    made = [(s * per_second + (per_second // 2 if i % 2 else 0), d) for i, (s, _, d) in enumerate(plain)]
    (tmp_path / "a.pcapng").write_bytes(block_capture(made, order, resolution, links=(1, 1)))
    columns = ["ts_sec", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "total_len", "protocol"]
    expected = frames_from_pcap(spark, str(tmp_path), glob="*.pcap").orderBy("seq").select(columns).collect()
    for split in (300, 1 << 20):
        got = frames_from_pcap(spark, str(tmp_path), split_bytes=split, glob="*.pcapng").orderBy("seq")
        assert got.select(columns).collect() == expected
        assert [r.ts.microsecond for r in got.collect()] == [500_000 * (i % 2) for i in range(80)]


def test_other_blocks_and_bad_block_files(spark, tmp_path):
    data = ethernet(ipv4(tcp(data=b"x" * 200)))
    (tmp_path / "a").write_bytes(block_capture([(5_000_000, data), (6_000_000, data, 2), (0, data, 3)]))
    rows = frames_from_pcap(spark, str(tmp_path), glob="a").orderBy("seq").collect()
    assert [(r.ts_sec, r.src_port) for r in rows] == [(5, 1234), (6, 1234), (0, 1234)]
    (tmp_path / "b").write_bytes(block_capture([(5, data)]) + block_capture([(5, data)]))
    with pytest.raises(Exception, match="after the first packet"):
        frames_from_pcap(spark, str(tmp_path), glob="b").count()
    (tmp_path / "c").write_bytes(block_capture([(5, data)], links=(113,)))
    with pytest.raises(Exception, match="link type 113"):
        frames_from_pcap(spark, str(tmp_path), glob="c").count()
    (tmp_path / "d").write_bytes(block_capture([(5, data)])[:-6])  # the last block is cut off
    assert frames_from_pcap(spark, str(tmp_path), glob="d").count() == 0


def test_written_captures_come_back(spark, tmp_path):
    from datetime import datetime, timezone

    from packetloom.sources.capture import write_pcap
    from packetloom.sources.tables import FRAME_SCHEMA

    at = datetime(2024, 5, 1, 1, 2, 3, 456789, tzinfo=timezone.utc)
    rows = [(i, at, int(at.timestamp()), "10.0.0.1", "192.168.255.2", i, 80, i % 256, 40 + i, 6, None) for i in range(500)]
    rows += [(900, at, 0, "1.2.3.4", "4.3.2.1", None, None, None, 99, 17, None), (901, at, 0, None, None, None, None, None, None, None, None)]
    write_pcap(spark.createDataFrame(rows, FRAME_SCHEMA).repartition(3), str(tmp_path / "out"))
    got = frames_from_pcap(spark, str(tmp_path / "out"), split_bytes=2000).orderBy("seq").drop("seq", "ts_sec").collect()
    assert [tuple(r) for r in got] == [(r[1].replace(tzinfo=None), *r[3:]) for r in rows]
    write_pcap(spark.createDataFrame([], FRAME_SCHEMA), str(tmp_path / "none"))
