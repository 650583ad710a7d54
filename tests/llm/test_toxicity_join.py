"""Which texts reach the join with their labels, and which tokens the decoder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import toxicity


def test_texts_without_a_label_do_not_reach_the_join(spark):
    rows = spark.range(-500, 4500).select(F.col("id").alias("_id"), F.lit("text").alias("_text"))
    rows = rows.unionByName(spark.createDataFrame([(None, "text")], "_id long, _text string"))
    ids = spark.createDataFrame([(i, i % 2) for i in range(-500, 4500, 5)] * 2 + [(10**12, 1)], "_id long, toxic int")
    left = [r["_id"] for r in toxicity._may_be_in(rows, ids).collect()]
    assert len(left) == len(set(left)) and set(range(-500, 4500, 5)) <= set(left)
    assert len(left) <= 1020
    assert toxicity._may_be_in(rows, ids.limit(0)).collect() == []


def test_text_ids_meet_their_labels(spark):
    rows = spark.createDataFrame([(f"d{i}", "text") for i in range(300)], "_id string, _text string")
    ids = rows.where("_id like 'd1%'").select("_id")
    left = {r["_id"] for r in toxicity._may_be_in(rows, ids).collect()}
    assert {r["_id"] for r in ids.collect()} <= left and len(left) <= 115


def test_ids_of_two_types_meet(spark):
    rows = spark.range(100).select(F.col("id").alias("_id"), F.lit("text").alias("_text"))
    ids = rows.where("_id < 50").select(F.col("_id").cast("int").alias("_id"))
    assert {r["_id"] for r in toxicity._may_be_in(rows, ids).collect()} >= set(range(50))
    assert toxicity._may_be_in(rows, ids.select(F.format_string("%03d", "_id").alias("_id"))).count() == 100


def test_texts_of_no_copy_are_not_shuffled_to_leave_copies_out(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 2800, 50)]
    rows = [(i, i % 2, t) for i, t in enumerate([*texts, texts[0], texts[1]])]
    kept = toxicity._without_copies(toxicity._keyed(spark.createDataFrame(rows, "_id long, toxic int, _text string")))
    assert sorted(r["_id"] for r in kept.collect()) == list(range(len(texts)))
    # a union: all rows without the bit of a copy come as they are, the others through the join
    apart = kept.where(F.col("_id").isin(0, 1))
    assert len(apart.collect()) == 2 and "Union" in kept._jdf.queryExecution().optimizedPlan().toString()


def test_smallest_orders(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("_order"))
    orders = sorted(r["_order"] for r in rows.collect())
    for n in (1, 700, 4999, 5000, 9000):
        assert sorted(r["_order"] for r in toxicity._smallest_order(rows, n).collect()) == orders[:n]


def test_what_can_hold_no_word_of_the_lexicon_is_not_decoded(monkeypatch):
    words = ["idiot", "scum", "du"]
    chars = toxicity.CharModel.fit(np.ones(toxicity._CODES**3), words)
    scorer = toxicity.Scorer(toxicity.ToxicityModel(chars, dict.fromkeys(words, 1.0), -1.0))
    decoded, decode = [], toxicity.Restorer.decode
    monkeypatch.setattr(toxicity.Restorer, "decode", lambda self, token: decoded.append(token) or decode(self, token))
    # none of these begins and ends with tokens of a word, though letters of one are inside
    assert scorer.found("ed ual to the end up of b1-d2 x-42y it is cum s ad u") == set()
    assert decoded == []
    assert scorer.found("an i d1 o t; $c-um") == {0, 1} == scorer.found("an i d1 o t; $c-um")
    assert len(decoded) == 2
    scorer.found("")
    assert toxicity.Scorer(toxicity.ToxicityModel(chars, {"***": 1.0, "7": 1.0}, -1.0)).found("a *** 7 b") == {0, 1}


@pytest.mark.parametrize("bits", [toxicity._BITS, 64])
@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_labels_told_by_bits_are_those_of_a_join(spark, monkeypatch, bits, kind):
    """Ids that are null, repeated, with both labels, or without a text; with 64 bits most tell a wrong label or both."""
    monkeypatch.setattr(toxicity, "_BITS", bits)
    rows = [(i, f"words of text {i} and no other text") for i in [*range(400), 3, 4, 4, None, None]] + [(5, "another text of five"), (6, None)]
    marked = [(i, int(i % 9 == 0)) for i in range(0, 500, 2)] + [(4, 1), (4, 1), (18, 0), (27, 1), (None, 0), (None, 1)]
    texts = spark.createDataFrame(rows, "_id long, _text string").select(F.col("_id").cast(kind).alias("_id"), F.coalesce("_text", F.lit("")).alias("_text")).repartition(3)
    marks = spark.createDataFrame(marked, "_id long, toxic int").select(F.col("_id").cast("int" if kind == "long" else kind).alias("_id"), "toxic")
    got = toxicity._labelled(texts, marks)
    plain = toxicity._keyed(texts).join(marks.distinct(), "_id").select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert toxicity._labelled(texts, marks.limit(0)).collect() == []


def test_texts_are_not_shuffled_to_meet_their_labels(spark, monkeypatch):
    texts = spark.range(0, 2000, 1, 4).select(F.col("id").alias("_id"), F.format_string("words of text %s", "id").alias("_text"))
    marks = spark.range(0, 2000, 2).select(F.col("id").alias("_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    marks = marks.unionByName(spark.createDataFrame([(8, 1)], "_id long, toxic int")).cache()
    written, measured = [], toxicity.measured
    monkeypatch.setattr(toxicity, "measured", lambda df: written.append(df) or measured(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labelled = toxicity._labelled(texts, marks)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (written[0], labelled)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # all texts are written without a join of their own, and read again so; the one with both labels (and few others) is joined
    assert all("SortMergeJoin" not in plan for plan in plans)
    assert labelled.count() == 1001 and 2 <= written[1].count() < 30
