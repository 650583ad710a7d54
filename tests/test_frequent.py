"""Frequent keys against plain sums, with fewer counters than keys."""

from collections import Counter

import pytest

from packetloom import EPOCH
from packetloom.operators import frequent
from packets import as_dicts, by_key, frame, packet, random_packets

KEYS = ["src_ip", "dst_ip"]


def sums(rows, keys):
    total, per_key = Counter(), Counter()
    for r in as_dicts(rows):
        total[r[EPOCH]] += r["total_len"]
        per_key[(r[EPOCH], *(r[k] for k in keys))] += r["total_len"]
    return total, per_key


@pytest.mark.parametrize("keys,one_in", [(["src_ip"], 3), (["src_ip"], 50), (KEYS, 80), (["dst_ip"], 1)])
@pytest.mark.parametrize("parts", [1, 7])
def test_every_frequent_key_is_found(spark, keys, one_in, parts):
    rows = random_packets(2000, seed=5)
    rows += [packet(5000 + i, epoch=i % 2, src=None, dst="d1", length=1400) for i in range(300)]
    total, per_key = sums(rows, keys)
    got = frequent.frequent_keys(frame(spark, rows).repartition(parts), keys, "total_len", one_in)
    assert by_key(got, keys, "count") == {k: v for k, v in per_key.items() if v * one_in >= total[k[0]]}


@pytest.mark.parametrize("counters", [1, 5, 30])
def test_bounds_hold_and_counters_are_few(spark, counters):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = random_packets(3000, seed=8, keys=60)
        total, per_key = sums(rows, KEYS)
        found = frequent.summary(frame(spark, rows).repartition(4), KEYS, "total_len", counters).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) <= 4 * 3 * counters < len(per_key)
    for r in found:
        assert r.lower <= per_key[(r[EPOCH], r.src_ip, r.dst_ip)] <= r.upper
        assert r.total == total[r[EPOCH]]
        assert 0 < (r.upper - r.lower) * (counters + 1) <= r.total  # keys were evicted, within the bound
    seen = {(r[EPOCH], r.src_ip, r.dst_ip) for r in found}
    lack = {r[EPOCH]: r.upper - r.lower for r in found}
    assert all(v <= lack[k[0]] for k, v in per_key.items() if k not in seen)


def test_nothing_and_too_few_counters(spark):
    assert frequent.frequent_keys(frame(spark, []), KEYS, 1, 3).count() == 0
    assert frequent.frequent_keys(frame(spark, [packet(1, length=0)]), KEYS, "total_len", 3).count() == 0
    with pytest.raises(ValueError, match="counters"):
        frequent.frequent_keys(frame(spark, []), KEYS, 1, 10, counters=9)
