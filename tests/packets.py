"""Hand-made and random packets, and brute-force results on plain rows."""

from __future__ import annotations

import random

from packetloom import EPOCH

SCHEMA = (
    "seq long, ts_sec long, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, "
    "total_len long, protocol int, epoch_id long"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def packet(seq, epoch=0, src="a", dst="b", sport=1, dport=2, flags=2, length=40, protocol=6, ts=None):
    return (seq, ts if ts is not None else epoch * 100, src, dst, sport, dport, flags, length, protocol, epoch)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_packets(n, seed=1, hot=0.4, keys=40, epochs=3):
    """One source sends ``hot`` of all packets."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        src = "hot" if rng.random() < hot else f"s{rng.randrange(keys)}"
        rows.append(
            packet(
                i,
                epoch=i * epochs // n,
                src=src,
                dst=f"d{rng.randrange(keys)}",
                sport=rng.randrange(5),
                dport=rng.randrange(20),
                flags=rng.choice([1, 2, 17, 18]),
                length=rng.randrange(40, 1500),
            )
        )
    return rows


def as_dicts(rows):
    return [dict(zip(NAMES, r)) for r in rows]


def by_key(df, keys, value):
    return {(r[EPOCH], *(r[k] for k in keys)): r[value] for r in df.collect()}
