"""Large groups of documents that have much in common and are not similar enough to link."""

import random
from fractions import Fraction

import numpy as np
import pytest

from packetloom.llm import components, jaccard_join
from packetloom.llm.vectors import shingle_sets


# as op6_jaccard_join and as the pipeline joins; a changed word changes ``size`` shingles
@pytest.mark.parametrize("t, size, changes", [(Fraction(9, 10), 3, (1, 12, 14, 16)), (Fraction(4, 5), 5, (1, 7, 8, 9))])
def test_unlike_pairs_of_a_hot_group_are_not_listed(spark, monkeypatch, t, size, changes):
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in r.sample(range(150), r.choice(changes)):
            words[at] = f"x{r.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = shingle_sets([x.encode() for x in texts], size)

    def similar(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return both >= t * (len(sets[i]) + len(sets[j]) - both)

    links = {(i, j) for i in range(len(texts)) for j in range(i) if similar(i, j)}
    listed = []
    verified = jaccard_join._verified

    def counting(pairs, *args):
        listed.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(jaccard_join, "_verified", counting)
    # no document is joined to others before the candidates are looked for
    for name in ("_bucket_links", "_block_links"):
        monkeypatch.setattr(jaccard_join, name, lambda *_: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard_join, "_compared", lambda kept, *_: kept.select("_id", jaccard_join.F.col("_id").alias("component")))
    got = jaccard_join.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), t, size)
    label = {i: i for i in range(len(texts))}
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert {(x["doc_id"], x["component_id"]) for x in got.collect()} == set(label.items())
    assert links and len(links) <= sum(listed) <= len(links) + len(texts)


def test_counters_never_rule_out_a_similar_pair():
    r = np.random.default_rng(5)
    t = Fraction(4, 5)
    for n in (1, 3, 60, 900, 40_000):  # the last ones have more than 255 in a bin
        for part in (0.5, 0.85, 0.9, 1.0):
            x = r.integers(0, 2**64, n, np.uint64)
            y = np.concatenate([x[: int(n * part)], r.integers(0, 2**64, n - int(n * part), np.uint64)])
            both = len(np.intersect1d(x, y))
            rows = [np.frombuffer(jaccard_join._counters(s), np.uint8)[None] for s in (x, y)]
            may = jaccard_join.possible(*rows, np.array([n]), np.array([n]), t)[0]
            assert may or 5 * both < 4 * (2 * n - both)


def test_few_links_are_written_by_few_tasks(spark, monkeypatch):
    written, cut = [], components.cut_lineage

    def counting(df):
        out = cut(df)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "cut_lineage", counting)
    least = spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(10 * least))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # two paths and a star, joined at their ends
        links = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(20)] + [(40, 105)] + [(300 - i, 299 - i) for i in range(9)]
        got = {(r["node"], r["component"]) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(i, 0) for i in [*range(41), *range(100, 120)]} | {(300 - i, 291) for i in range(10)}
    assert len(written) > 2 and max(written[1:]) <= least


def unlike_texts(n, line, r):
    """Short texts of all sizes around a common line, the last tenth near copies of others."""
    texts = []
    for i in range(n):
        if i >= n - n // 10:
            texts.append(texts[r.randrange(i)] + f" y{i}")
            continue
        words = [f"v{r.randrange(10**9)}" for _ in range(r.randrange(8, 300))]
        at = r.randrange(len(words))
        texts.append(" ".join([*words[:at], *line, *words[at:]]))
    return texts


def test_unlike_documents_of_a_hot_group_are_ruled_out_before_sets_are_made(spark, monkeypatch):
    """The documents that share a hot shingle grow with the corpus, those of them that are alike do not."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 16)
    r, t, n = random.Random(6), Fraction(9, 10), 400
    texts = unlike_texts(n, ["it", "is", "said"], r)
    sets = shingle_sets([x.encode() for x in texts], 3)
    similar = {(i, j) for i in range(n) for j in range(i) if 10 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 9 * (len(sets[i]) + len(sets[j]) - both)}
    rows = spark.createDataFrame([(i, x, 5, n) for i, x in enumerate(texts)], "_id long, _text string, token long, held long")
    kept = jaccard_join._sketched(jaccard_join.pack(rows, "_text"), 3).cache()
    made, met = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    unpacked, linked = jaccard_join._unpacked_sets, jaccard_join._linked

    def counting_sets(values, size):
        made.add(len(values))
        return unpacked(values, size)

    def counting_rows(table, *args):
        met.add(table.num_rows)
        return linked(table, *args)

    kept.count()
    monkeypatch.setattr(jaccard_join, "_unpacked_sets", counting_sets)
    monkeypatch.setattr(jaccard_join, "_linked", counting_rows)
    labels = spark.createDataFrame([], "_id long, component long")
    found = {(max(x), min(x)) for x in jaccard_join._block_links(kept, labels, 3, t).collect()}
    # which of several links join a group is not told
    assert found <= similar and similar
    label = [{i: i for i in range(n)} for _ in range(2)]
    for of, links in zip(label, (found, similar), strict=True):
        for _ in range(n):
            for i, j in links:
                of[i] = of[j] = min(of[i], of[j])
            if all(of[i] == of[j] for i, j in links):
                break
    assert label[0] == label[1]
    # every document met all 25 blocks twice, and each of them had its set made there
    assert made.value < 4 * n and met.value < n * 25


def test_sizes_of_similar_sets_are_at_most_one_class_apart(spark):
    for t in (Fraction(9, 10), Fraction(4, 5), Fraction(1, 2), Fraction(1)):
        n = spark.range(1, 3000).select(jaccard_join.F.col("id").alias("n")).withColumn("class", jaccard_join.size_class("n", t))
        of = {x["n"]: x["class"] for x in n.collect()}
        assert all(0 <= of[m] - of[k] <= 1 for k in of for m in range(k, min(2999, k * t.denominator // t.numerator) + 1))
