"""Chains by doubling, and the next known value, against loops."""

import random
import time
from bisect import bisect_left

from pyspark.sql import functions as F

from packetloom.functions.chains import first_at_least, reached


def test_reached_follows_long_chains(spark):
    steps = [("a", i, i + 1 if i % 100 != 99 else None) for i in range(300)] + [("b", 0, 5), ("b", 5, None), ("b", 7, 5)]
    df = spark.createDataFrame(steps, "path string, start long, next long")
    roots = spark.createDataFrame([("a", 130), ("b", 0), ("c", 1)], "path string, start long")
    got = sorted(tuple(r) for r in reached(df, roots, ["path"]).collect())
    assert got == [("a", i) for i in range(130, 200)] + [("b", 0), ("b", 5), ("c", 1)]
    alone = reached(df.where("path = 'a'").drop("path"), roots.where("path = 'a'").drop("path"))
    assert sorted(r.start for r in alone.collect()) == [*range(130, 200)]


def test_first_at_least(spark):
    rng = random.Random(3)
    for known, asked in (
        (rng.sample(range(-500, 500), 200), [rng.randrange(-600, 600) for _ in range(300)]),
        ([], [1, 2]),
        ([5], [5, 5, 6]),
        ([1], []),
    ):
        frames = [spark.createDataFrame([(v,) for v in values], "value long").repartition(5) for values in (asked, known)]
        ordered = sorted(known)
        expected = {a: ordered[i] if (i := bisect_left(ordered, a)) < len(ordered) else None for a in asked}
        rows = first_at_least(*frames).collect()
        assert len(rows) == len(expected) and {r.value: r.found for r in rows} == expected


def test_first_at_least_on_many_values_of_one_slice(spark):
    """The work grows with the values, not with their square: one slice of 80,000 took minutes."""
    n = 80_000
    known = spark.range(0, 7 * n, 7).select(F.col("id").alias("value"))
    asked = spark.range(0, 7 * n, 5 * 7).select((F.col("id") - 3).alias("value")).unionByName(spark.range(1).select(F.lit(7 * n).alias("value")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    began = time.monotonic()
    try:
        got = {r.value: r.found for r in first_at_least(asked, known).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert time.monotonic() - began < 40
    assert got == {35 * i - 3: 35 * i for i in range(n // 5)} | {7 * n: None}
