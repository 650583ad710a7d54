"""Sketches against loops over packets, and the properties they promise."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from packetloom import EPOCH
from packetloom.operators import counters, coupons, membership, stats
from packetloom.operators.methods import distinct_by, reduce_by
from packetloom.operators.relational import distinct_exact, filter_eq, reduce_exact
from packets import as_dicts, by_key, frame, packet, random_packets

KEYS = ["src_ip", "dst_ip"]
SEED = 42


def place(index, text, width):
    return int(hashlib.md5(f"{SEED + index}:{text}".encode()).hexdigest()[:8], 16) % width


def text(row, keys=KEYS):
    return ",".join("<missing>" if row[k] is None else str(row[k]) for k in keys)


def key(row, keys=KEYS):
    return (row[EPOCH], *(row[k] for k in keys))


@pytest.fixture(scope="module")
def rows():
    return random_packets(600, seed=11)


@pytest.fixture(scope="module")
def packets(spark, rows):
    return frame(spark, rows).repartition(6).cache()


@pytest.fixture(scope="module")
def exact(packets):
    return by_key(reduce_exact(packets, KEYS, "total_len"), KEYS, "count")


def loop_cms(rows, depth, width):
    """Estimate of every key at its last packet, and at the end of the epoch."""
    cells, arrival, names = defaultdict(int), {}, {}
    for r in as_dicts(rows):
        for i in range(depth):
            cells[r[EPOCH], i, place(i, text(r), width)] += r["total_len"]
        read = lambda t: min(cells[r[EPOCH], i, place(i, t, width)] for i in range(depth))
        arrival[key(r)] = read(text(r))
        names[key(r)] = text(r)
    final = {k: min(cells[k[0], i, place(i, t, width)] for i in range(depth)) for k, t in names.items()}
    return arrival, final


def test_count_min_equals_loop(packets, rows):
    arrival, final = loop_cms(rows, 2, 16)
    small = {"memory_in_bytes": 2 * 16 * 4, "depth": 2}
    assert by_key(counters.reduce_cms(packets, KEYS, "total_len", **small), KEYS, "count") == final
    assert by_key(counters.reduce_cms(packets, KEYS, "total_len", mode="arrival", **small), KEYS, "count") == arrival
    assert arrival != final


def loop_tree(rows, depth, width, t1, t2):
    l1, l2, l3, out, deepest = defaultdict(int), defaultdict(int), defaultdict(int), {}, 0
    for r in as_dicts(rows):
        estimates = []
        for i in range(depth):
            b, v = place(i, text(r), width), r["total_len"]
            l1[r[EPOCH], i, b] += v
            estimate = l1[r[EPOCH], i, b]
            if estimate > t1:
                l2[r[EPOCH], i, b // 8] += v
                estimate = l2[r[EPOCH], i, b // 8] + t1
                if estimate > t2:
                    l3[r[EPOCH], i, b // 64] += v
                    estimate = l3[r[EPOCH], i, b // 64] + t1 + t2
                    deepest += 1
            estimates.append(estimate)
        out[key(r)] = min(estimates)
    assert deepest > 20
    return out


TREE = {"depth": 2, "width_l1": 128, "width_l2": 16, "width_l3": 2, "threshold_l1": 2000, "threshold_l2": 9000}


def test_counter_tree_arrival_equals_loop(packets, rows):
    got = counters.reduce_fcm(packets, KEYS, "total_len", mode="arrival", **TREE)
    assert by_key(got, KEYS, "count") == loop_tree(rows, 2, 128, 2000, 9000)


def test_arrival_stores_only_crossing_points(packets, rows, monkeypatch):
    stored = []
    cut = counters.cut_lineage

    def counted(df):
        made = cut(df)
        stored.append((made.columns, made.count()))
        return made

    monkeypatch.setattr(counters, "cut_lineage", counted)
    counters.reduce_fcm(packets, KEYS, "total_len", mode="arrival", **TREE).collect()
    epochs_seen = len({r["epoch_id"] for r in as_dicts(rows)})
    assert [c[-1] for c, _ in stored] == ["_first", "_second"]
    assert stored[0][1] <= epochs_seen * TREE["depth"] * TREE["width_l1"] and stored[1][1] <= epochs_seen * TREE["depth"] * TREE["width_l2"]
    assert all(n > 0 for _, n in stored)


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_crossings_equal_running_sums(spark, bits):
    rng = random.Random(bits)
    made = [(rng.randrange(4), i, rng.choice([0, 0, 1, 5, 40])) for i in range(400)]
    df = spark.createDataFrame(made, "c int, seq long, _v long").repartition(5)
    for limit in (0, 1, 300, 10**6):
        total, expected = defaultdict(int), {}
        for c, seq, v in made:
            total[c] += v
            if total[c] > limit:
                expected.setdefault(c, seq)
        assert {r.c: r.at for r in counters.crossings(df, ["c"], limit, "at", bits).collect()} == expected



@pytest.mark.parametrize("hash", ["md5", "xxhash64"])
@pytest.mark.parametrize(
    "method,params",
    [
        ("cms", {"memory_in_bytes": 128, "depth": 2}),
        ("fcm", TREE),
        ("fcm_l1", {"depth": 2, "width_l1": 16}),
        ("elastic", {"depth": 2, "width": 16}),
    ],
)
def test_never_below_exact(packets, exact, method, params, hash):
    got = by_key(reduce_by(packets, KEYS, "total_len", method, hash=hash, **params), KEYS, "count")
    assert got.keys() == exact.keys()
    assert all(got[k] >= exact[k] for k in exact)
    assert any(got[k] > exact[k] for k in exact)


@pytest.mark.parametrize(
    "method,params,width,depth",
    [
        ("cms", {"memory_in_bytes": 4 * 3 * 1_000_003, "depth": 3}, 1_000_003, 3),
        ("fcm", {"width_l1": 1 << 20, "width_l2": 1 << 17, "width_l3": 1 << 14, "threshold_l1": 1 << 30, "threshold_l2": 1 << 30}, 1 << 20, 2),
        ("fcm_l1", {"depth": 3, "width_l1": 1_000_003}, 1_000_003, 3),
        ("elastic", {"depth": 3, "width": 1_000_003}, 1_000_003, 3),
    ],
)
def test_wide_sketch_is_exact(packets, rows, exact, method, params, width, depth):
    texts = {text(r) for r in as_dicts(rows)}
    # every key has a row of its own somewhere
    lonely = set()
    for i in range(depth):
        used = Counter(place(i, t, width) for t in texts)
        lonely |= {t for t in texts if used[place(i, t, width)] == 1}
    assert lonely == texts
    assert by_key(reduce_by(packets, KEYS, "total_len", method, **params), KEYS, "count") == exact


def test_elastic_heavy_flag(packets):
    got = counters.reduce_elastic(packets, KEYS, "total_len", depth=2, width=16, heavy_threshold=12000).collect()
    assert {r.is_heavy for r in got} == {True, False}
    assert all(r.is_heavy == (r["count"] > 12000) for r in got)


def test_order_of_input_does_not_matter(spark, rows):
    a, b = frame(spark, rows).repartition(2), frame(spark, rows[::-1]).repartition(9)
    bloom = {"size": 97, "num_hashes": 3}
    for make in (
        lambda df: counters.reduce_fcm(df, KEYS, "total_len", **TREE),
        lambda df: counters.reduce_fcm(df, KEYS, "total_len", mode="arrival", **TREE),
        lambda df: membership.distinct_bloom(df, KEYS, **bloom),
        lambda df: coupons.reduce_beaucoup(df, ["src_ip"], num_coupons=64),
    ):
        assert sorted(map(str, make(a).collect())) == sorted(map(str, make(b).collect()))


def test_tree_parameters_are_checked(packets):
    with pytest.raises(ValueError):
        counters.reduce_fcm(packets, KEYS, 1, width_l1=1000, width_l2=10, width_l3=10)
    with pytest.raises(ValueError):
        counters.reduce_fcm(packets, KEYS, 1, threshold_l1=10, threshold_l2=5)
    for bad in (lambda: reduce_by(packets, KEYS, 1, "magic"), lambda: distinct_by(packets, KEYS, "magic")):
        with pytest.raises(ValueError, match="magic"):
            bad()
    with pytest.raises(ValueError, match="mode"):
        counters.reduce_cms(packets, KEYS, 1, mode="sideways")
    with pytest.raises(ValueError, match="hash"):
        counters.reduce_cms(packets, KEYS, 1, hash="sha0")


def test_null_keys_in_sketches(spark):
    df = frame(spark, [packet(1, src=None), packet(2, src=None), packet(3, src="a")])
    wide = {"memory_in_bytes": 4 * 2 * 10_007, "depth": 2}
    assert by_key(counters.reduce_cms(df, KEYS, 1, **wide), KEYS, "count") == {(0, None, "b"): 2, (0, "a", "b"): 1}
    assert membership.distinct_bloom(df, KEYS).count() == 2
    assert membership.bloom_semi_join(df, df, KEYS, KEYS).count() == 3


def test_point_estimate_of_absent_key(spark):
    df = frame(spark, [packet(1, src="a"), packet(2, src="a")])
    table = counters.build_counters(df, ["src_ip"], 1, depth=2, width=1009)
    probes = spark.createDataFrame([(0, "a"), (0, "zz"), (7, "a")], "epoch_id long, src_ip string")
    got = by_key(counters.point_estimate(table, probes, ["src_ip"], depth=2, width=1009), ["src_ip"], "estimate")
    assert got == {(0, "a"): 2, (0, "zz"): 0, (7, "a"): 0}


# --- Bloom filters ----------------------------------------------------------------------


def loop_bloom(rows, size, hashes):
    bits, passed = set(), []
    for r in as_dicts(rows):
        mine = {(r[EPOCH], place(i, text(r), size)) for i in range(hashes)}
        if not mine <= bits:
            passed.append(r["seq"])
        bits |= mine
    return passed


@pytest.mark.parametrize("size,hashes", [(97, 3), (31, 1), (400, 5)])
def test_bloom_distinct_equals_loop(packets, rows, size, hashes):
    got = membership.distinct_bloom(packets, KEYS, size=size, num_hashes=hashes, first_row=True)
    assert sorted(r.seq for r in got.collect()) == loop_bloom(rows, size, hashes)


def test_wide_bloom_is_exact_and_narrow_one_drops(packets):
    everything = set(map(tuple, distinct_exact(packets, KEYS).collect()))
    wide = membership.distinct_bloom(packets, KEYS, size=10_000_019, num_hashes=5)
    narrow = membership.distinct_bloom(packets, KEYS, size=97, num_hashes=3)
    assert set(map(tuple, wide.collect())) == everything
    kept = set(map(tuple, narrow.collect()))
    assert kept < everything


def test_bloom_semi_join_has_no_false_negatives(packets):
    syn, other = filter_eq(packets, {"tcp_flags": 2}), filter_eq(packets, {"tcp_flags": 18})
    truth = {r.seq for r in other.join(syn.select(EPOCH, *KEYS), [EPOCH, *KEYS], "left_semi").collect()}
    narrow = {r.seq for r in membership.bloom_semi_join(other, syn, KEYS, KEYS, size=97, num_hashes=3).collect()}
    wide = {r.seq for r in membership.bloom_semi_join(other, syn, KEYS, KEYS, size=10_000_019).collect()}
    assert truth < narrow
    assert wide == truth


# --- coupons ----------------------------------------------------------------------------


def test_coupon_rows_equal_loop(packets, rows):
    m, n, d, draws = 4, 200, 2, 2
    filled = defaultdict(set)
    for r in as_dicts(rows):
        for i in range(d):
            for j in range(draws):
                filled[r[EPOCH], place(i, r["src_ip"], m)].add(place(i, f"{j}:{r['seq']}", n))
    expected = {}
    for r in as_dicts(rows):
        k = max(len(filled[r[EPOCH], place(i, r["src_ip"], m)]) for i in range(d))
        expected[r[EPOCH], r["src_ip"]] = 0 if k >= n else math.floor(n * math.log(n / (n - k)))
    got = coupons.reduce_beaucoup(packets, ["src_ip"], num_rows=m, num_coupons=n, d=d, max_coupons_per_packet=draws)
    assert by_key(got, ["src_ip"], "count") == expected


def test_empty_and_full_coupon_rows(spark, packets):
    k = spark.createDataFrame([(0,), (1,), (15,), (16,)], "k long")
    got = [r[0] for r in k.select(coupons.coupon_estimate(k.k, 16)).collect()]
    assert got == [0, 1, math.floor(16 * math.log(16)), 0]
    full = coupons.reduce_beaucoup(packets, ["src_ip"], num_rows=1, num_coupons=2)
    assert {r["count"] for r in full.collect()} == {0}


def test_coupon_distinct_counts_values(spark):
    rows = [packet(i, src="a", dst=f"d{i % 500}") for i in range(2000)]
    got = coupons.coupon_distinct(frame(spark, rows), ["src_ip"], ["dst_ip"], num_coupons=4096).first()
    assert abs(got.distinct_values - 500) < 50


def test_coupon_membership(spark):
    table = coupons.coupon_table(frame(spark, [packet(1, src="a")]), ["src_ip"], num_rows=1000, d=2)
    probes = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "epoch_id long, src_ip string")
    found = coupons.beaucoup_contains(table, probes, ["src_ip"], num_rows=1000, d=2).collect()
    assert [tuple(r) for r in found] == [(0, "a")]


# --- statistics -------------------------------------------------------------------------


def test_cardinality_near_truth_and_null_when_full(packets):
    truth = Counter(r[EPOCH] for r in distinct_exact(packets, KEYS).collect())
    got = {r[EPOCH]: r.cardinality for r in stats.cardinality_linear(packets, KEYS, width=4096).collect()}
    assert got.keys() == truth.keys()
    assert all(abs(got[e] - truth[e]) < 0.1 * truth[e] for e in truth)
    full = stats.cardinality_linear(packets, KEYS, depth=1, width=2).collect()
    assert [r.cardinality for r in full] == [None] * 3
    light = stats.light_count(packets, KEYS, 1, width=2)
    assert [r.cardinality for r in stats.light_cardinality(light, 2).collect()] == [None] * 3


def test_light_counters_saturate(packets):
    values = [r.value for r in stats.light_count(packets, KEYS, "total_len", width=64).collect()]
    assert max(values) == 255
    capped = stats.light_max(packets, KEYS, "total_len", width=64).collect()
    assert max(r.value for r in capped) == 255 and min(r.value for r in capped) >= 40


def test_distribution_covers_all_counters(packets):
    light = stats.light_count(packets, KEYS, 1, width=64).cache()
    bins = defaultdict(dict)
    for r in stats.flow_size_distribution(light, 64).collect():
        bins[r[EPOCH]][r.value] = r.counters
    loop = defaultdict(Counter)
    for r in light.collect():
        loop[r[EPOCH]][r.value] += 1
    for epoch, counted in bins.items():
        assert sorted(counted) == list(range(256)) and sum(counted.values()) == 64
        assert {v: n for v, n in counted.items() if n and v} == loop[epoch]
    for r in stats.flow_entropy(light).collect():
        sizes = loop[r[EPOCH]]
        total = sum(n * v for v, n in sizes.items())
        entropy = -sum(n * v / total * math.log2(v / total) for v, n in sizes.items())
        assert r.total == total and math.isclose(r.entropy, entropy)


def test_fold_keeps_the_largest(packets):
    light = stats.light_count(packets, KEYS, 1, width=64).cache()
    folded = {(r[EPOCH], r.bucket): r.value for r in stats.light_fold(light, 64, 4).collect()}
    expected = defaultdict(int)
    for r in light.collect():
        expected[r[EPOCH], r.bucket % 16] = max(expected[r[EPOCH], r.bucket % 16], r.value)
    assert folded == expected
    plain = by_key(stats.light_query(light, packets, KEYS, width=64), KEYS, "estimate")
    shrunk = by_key(stats.light_query(stats.light_fold(light, 64, 4), packets, KEYS, width=64, ratio=4), KEYS, "estimate")
    assert plain.keys() == shrunk.keys() and all(shrunk[k] >= plain[k] for k in plain)


def test_heavy_hitters(packets, exact):
    for k in (5, 5000):
        got = stats.heavy_hitters(packets, KEYS, "total_len", k).collect()
        for epoch in range(3):
            best = sorted(((-v, key) for key, v in exact.items() if key[0] == epoch))[:k]
            mine = sorted((r.position, r.src_ip, r.dst_ip, r["count"]) for r in got if r[EPOCH] == epoch)
            assert mine == [(i + 1, key[1], key[2], -v) for i, (v, key) in enumerate(best)]
    counts = by_key(reduce_exact(packets, ["src_ip"], 1), ["src_ip"], "count")
    approx = stats.heavy_hitters_approx(packets, ["src_ip"], 5).collect()
    for epoch in range(3):
        mine = {r.flow_key.removeprefix("src_ip: "): r["count"] for r in approx if r[EPOCH] == epoch}
        assert all(counts[epoch, k] == n for k, n in mine.items())
        assert sorted(mine.values()) == sorted(n for (e, _), n in counts.items() if e == epoch)[-5:]


def test_coupon_bitmaps_are_united(spark):
    """Tables of parts of the packets give the table of all, also with more coupons than one bitmap holds."""
    rows = random_packets(3000)
    for n in (64, 100_000):
        own = {"num_rows": 4, "num_coupons": n, "d": 2}
        made = lambda some: coupons.coupon_bitmaps(frame(spark, some), KEYS, **own)
        united = coupons.unite_bitmaps(made(rows[::2]).unionByName(made(rows[1::2])))
        held = by_key(coupons.coupons_held(united), ["_row"], "_coupons")
        assert held == by_key(coupons.coupon_table(frame(spark, rows), KEYS, **own), ["_row"], "_coupons")
        draws = defaultdict(set)
        for r in as_dicts(rows):
            for i in range(2):
                for j in range(2):
                    draws[(r[EPOCH], place(i, text(r), 4))].add(place(i, f"{j}:{r['seq']}", n))
        assert held == {k: len(v) for k, v in draws.items()}
