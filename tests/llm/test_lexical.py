"""Ranked search against scores worked out one by one in whole numbers."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from packetloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score int, rank string"
ITEMS = "item_id int, text string, score int"
WORDS = [f"w{i}" for i in range(40)] + ["Été", "été", "ÉTÉ", "naïve", "中文字", "🎈", "a1", "A1"]


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain(docs, items, k=20):
    bags = [(i, Counter(split(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(split(t))
    rows = []
    for item, said in asked.items():
        scored = []
        for doc, bag in bags:
            score = 0
            for term, times in said.items():
                if bag[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 100 - 25 + 25 * bag.total() * n_docs // total
                    score += times * w * (10**9 * bag[term] // (1000 * bag[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        rows += [(item, r, s[2], -s[0]) for r, s in enumerate(scored[:k], 1)]
    return Counter(rows)


def prose(rng, n):
    return rng.choice([" ", "-", "\n"]).join(rng.choice(WORDS) for _ in range(n))


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 5, "x") for r in docs], DOCS).repartition(4)
    i = spark.createDataFrame([(*r, 5) for r in items], ITEMS)
    found = lexical.search(d, i, **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, found.collect()))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randrange(60))) for i in range(300)]
    docs += [(i, "w1 w2 w3") for i in range(400, 460)]  # more ties than places
    docs += [(500, "w1 w2 w3"), (500, "w1 w2 w3"), (None, "w1 w2 w3"), (-7, "w1 w2 w3"), (600, None), (601, ""), (602, "?!")]
    docs += [(700, prose(rng, 200_000))]
    items = [(i, prose(rng, rng.randrange(1, 30))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "unheard"), (33, "w1 w1 w2"), (33, "w1"), (None, "w5 w6"), (34, "w3")]
    return docs, items


def test_equals_plain_scores(spark, tables):
    assert run(spark, *tables) == plain(*tables)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_other_numbers_of_places(spark, tables, k):
    assert run(spark, *tables, k=k) == plain(*tables, k=k)


def test_small_tiles_and_several_passes(spark, tables, monkeypatch):
    monkeypatch.setattr(lexical, "PASS_TERMS", 60)
    whole = lexical.tiles
    monkeypatch.setattr(lexical, "tiles", lambda *a: _cut(whole, *a))
    assert run(spark, *tables) == plain(*tables)


def _cut(whole, *arrays):
    old = lexical.TILE_TERMS, lexical.TILE_ITEMS
    lexical.TILE_TERMS, lexical.TILE_ITEMS = 5, 3
    try:
        return whole(*arrays)
    finally:
        lexical.TILE_TERMS, lexical.TILE_ITEMS = old


def test_counts_too_large_for_one_tile(spark):
    items = [(1, "rare " * 700_000 + "w1"), (2, "rare w2")]
    docs = [(i, "rare rare w1" if i < 2 else f"w{i % 5} w1") for i in range(3000)]
    assert run(spark, docs, items) == plain(docs, items)


def test_tiles_stay_exact():
    rng = np.random.default_rng(1)
    items = np.repeat(np.arange(50), 30)
    term = np.concatenate([rng.choice(200, 30, replace=False) for _ in range(50)])
    count = rng.integers(1, 1_000_000, len(items))
    weight = rng.integers(1, 30_000, 200)
    made = lexical.tiles(items, term, count, weight)
    total = np.zeros((50, 200), np.int64)
    for tile in made:
        table = tile.dense()
        assert (table @ (weight[tile.vocabulary] * 1_000_000)).max() < 2**53
        total[np.ix_(tile.items, tile.vocabulary)] += table.astype(np.int64)
    expected = np.zeros((50, 200), np.int64)
    np.add.at(expected, (items, term), count)
    assert (total == expected).all()


def test_empty_tables_and_ids_of_text(spark):
    assert not run(spark, [], [(1, "a")])
    assert not run(spark, [(1, "a")], [])
    assert not run(spark, [(1, None)], [(1, "a")])
    with pytest.raises(ValueError, match="whole number"):
        lexical.search(spark.createDataFrame([("x", "a")], "doc_id string, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string"))
