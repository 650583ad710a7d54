"""Hard negatives against scores of all pairs in whole numbers."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from packetloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score int, rank string"


def plain(rows, every=10, k=5, n=5, low=80, high=100):
    """Everything against everything."""
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(x)) for x in v], label))
    out = Counter()
    for i, v, label in good:
        if i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        same = sorted((-score(w), j) for j, w, lab in good if lab == label and j != i)[:k]
        other = sorted((-score(w), j) for j, w, lab in good if lab != label)
        for ps, pos in same:
            inside = [(s, j) for s, j in other if low * -ps <= 100 * -s <= high * -ps][:n]
            for r, (s, j) in enumerate(inside, 1):
                out[(i, pos, r, j, -ps, -s)] += 1
    return out


def run(spark, rows, every=10, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    found = negatives.mine(df, f"vec_id % {every} = 0", **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, found.collect()))


def vectors(seed, n, dims=24, labels=4, scale=0.2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dims)) * scale
    made = []
    for i in range(n):
        label = int(rng.integers(labels))
        # float32, as the table has it
        made.append((i, [float(np.float32(x)) for x in centre[label] * 0.5 + rng.normal(size=dims) * scale], label))
    return made


ODD = [
    (1000, None, 1),
    (1010, [1.0] * 24, None),
    (1020, [1.0, None] + [0.0] * 22, 1),
    (1030, [float("nan")] * 24, 1),
    (1040, [float("inf")] + [0.0] * 23, 1),
    (None, [0.5] * 24, 1),
    (1050, [], 2),
    (1060, [0.25, -0.5], 2),
    (1070, [0.0] * 24, 9),  # the only one of its label
    (1080, [0.1] * 24, 7),
    (1081, [-0.1] * 24, 7),  # a positive with a score below 0
]


@pytest.fixture(scope="module")
def table():
    rows = vectors(1, 400) + ODD
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(60)]  # a group of copies, and some of another label
    rows += [(3000 + i, rows[7][1], (rows[7][2] + 1) % 4) for i in range(30)]
    rows += [rows[10], rows[10], rows[11]]  # repeated rows
    return rows


def test_equals_all_pairs(spark, table):
    assert run(spark, table) == plain(table)


@pytest.mark.parametrize("k,n,low,high", [(3, 7, 50, 120), (1, 1, 95, 99)])
def test_other_windows(spark, table, k, n, low, high):
    assert run(spark, table, positives=k, negatives=n, low_percent=low, high_percent=high) == plain(table, 10, k, n, low, high)


def test_small_sample_and_several_passes(spark, table, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(negatives, "PASS_ANCHORS", 20)
    assert run(spark, table) == plain(table)


def test_nothing(spark):
    assert not run(spark, [])
    assert not run(spark, [(1, [1.0], 1)])
    assert not run(spark, [(0, [1.0], 1)])
    assert not run(spark, [(0, [float("nan")], 1)])


@pytest.mark.parametrize("dims,scale", [(1, 1), (40, 1), (40, 1 << 18), (64, 3)])
def test_index_finds_all_pairs_above_thresholds(monkeypatch, dims, scale):
    monkeypatch.setattr(negatives, "TILE", 50)
    rng = np.random.default_rng(dims)
    own, rows = (np.floor(rng.normal(size=(n, dims)) * 100 * rng.gamma(1, 1, (n, 1))) * scale for n in (120, 300))
    score = own.astype(np.int64) @ rows.astype(np.int64).T
    index = negatives.DimensionIndex(own)
    for share in (0, 0.5, 0.9, 0.99, 1):
        limit = np.quantile(score, share, axis=1, method="lower").astype(float)
        limit[:3] = negatives.LOWEST
        limit[3:6] = negatives.HIGHEST
        found = {(a, r, s) for anchor, row, sc in index.pairs(rows, limit) for a, r, s in zip(anchor.tolist(), row.tolist(), sc.tolist())}
        a, r = np.nonzero(score >= limit[:, None])
        assert found == set(zip(a.tolist(), r.tolist(), score[a, r].tolist()))


def test_index_leaves_dimensions_out():
    own = np.full((4, 64), 10.0)
    index = negatives.DimensionIndex(own)
    seen = []
    tile = negatives._tile
    try:
        negatives._tile = lambda own, left, depth, *rest: seen.append(depth.tolist()) or tile(own, left, depth, *rest)
        list(index.pairs(np.full((5, 64), 10.0), np.array([6400.0, 3300, 1700, 7000])))
    finally:
        negatives._tile = tile
    assert seen == [[4, 3, 1]]  # the last anchor is out of reach, the first needs only one chunk


def test_numbers_that_do_not_fit(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(i, [1e16], 1) for i in range(3)])
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e5, 1e5) * 2**rng.randrange(4) for _ in range(3)], i % 2) for i in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert run(spark, rows) == plain(rows)
