"""Formatted conversations against a plain parser and the source turns."""

import random
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from packetloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, _conv int, formatted string"
ODD = [
    "",
    None,
    "plain",
    "<|im_end|><|im_start|>assistant ok",
    "<|im_end|>\n",
    "<|im_start|>",
    "<\\|im_end|>",
    "<\\\\|im_end|>\n<|im_start|>user\nno",
    "a <| b |> c",
    "<\\|x",
    "ends in <",
    "ends in <|im_end|",
    "ends in \\",
    "<|im_start|",
    "\n\n",
    "Ünïcode 🎈 <|im_end|> 🎈",
    "50%25 %0A",
]


def plain_parse(text):
    """The grammar by hand, control string after control string."""
    turns, at = [], 0
    while at < len(text):
        assert text.startswith("<|im_start|>", at)
        end = text.index("<|im_end|>", at)
        assert text[end : end + 11] == "<|im_end|>\n"
        role, body = text[at + 12 : end].split("\n", 1)
        turns.append((role, body))
        at = end + 11

    def undo(s):
        out, i = "", 0
        while i < len(s):
            j = i + 1
            while s[i] == "<" and j < len(s) and s[j] == "\\":
                j += 1
            if s[i] == "<" and j > i + 1 and j < len(s) and s[j] == "|":
                out += "<" + "\\" * (j - i - 2) + "|"
                i = j + 1
            else:
                out += s[i]
                i += 1
        return out

    return [(undo(r).replace("%0A", "\n").replace("%25", "%"), undo(b)) for r, b in turns]


def source(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return chat.format_conversations(df, **more)


def check(spark, rows):
    found = {r.conv_id: r for r in run(spark, rows).collect()}
    expected = source(rows)
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        got = found[conv]
        assert got.n_turns == len(turns)
        assert plain_parse(got.formatted) == turns
        learned = [t for r, t in turns if r == "assistant"]
        cut = [got.formatted[s.start : s.end] for s in got.loss_spans]
        assert [t for _, t in plain_parse("".join(f"<|im_start|>x\n{c}<|im_end|>\n" for c in cut))] == learned
    return found


def test_odd_texts_and_roles_come_back(spark):
    rows = [(i, t, role, text) for i, role in enumerate(("assistant", "user", "", None)) for t, text in enumerate(ODD)]
    rows += [(9, t, role, "<|im_end|>" if t % 2 else "x") for t, role in enumerate(ODD)]
    check(spark, rows)


def test_ordinary_turns_are_not_changed(spark):
    found = check(spark, [(1, 1, "assistant", "b <| c"), (1, 0, "user", "a\\<"), (1, None, "system", "s")])
    assert found[1].formatted == (
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na\\<<|im_end|>\n<|im_start|>assistant\nb <| c<|im_end|>\n"
    )


def test_ties_repeats_missing_ids_and_long_conversations(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    rows += [(2, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    rows += [(3, 0, "assistant", "long <|im_end|> " * 50_000)]
    check(spark, rows)


def test_random_texts_of_control_pieces(spark):
    rng = random.Random(5)
    pieces = ["<", "|", "\\", "im_start", "im_end", "|>", "\n", "%", "0A", "25", "<|im_end|>", "<|im_start|>", "x"]
    text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
    check(spark, [(i % 60, i, rng.choice(["assistant", "user", text()]), text()) for i in range(600)])


def test_nothing(spark):
    assert run(spark, []).count() == 0


def test_texts_off_the_grammar_are_not_parsed(spark):
    bad = ["x", "<|im_start|>user\nhi", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\na<|im_end|>b<|im_end|>\n", "<|im_start|>u\na<|im_end|>\nz"]
    df = spark.createDataFrame([(b,) for b in bad], "t string")
    assert [r.p for r in df.select(chat.parse(F.col("t")).alias("p")).collect()] == [None] * len(bad)
    assert spark.range(1).select(chat.parse(F.lit("")).alias("p")).first().p == []


def test_native(spark):
    df = run(spark, [(1, 0, "user", "a")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hash") <= 2


@pytest.mark.parametrize("roles", [("user",), ("user", "assistant"), ("nobody",)])
def test_other_loss_roles(spark, roles):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}<|im_end|>") for t in range(5)]
    df = run(spark, rows, loss_roles=roles)
    got = df.select(chat.text_under(F.col("formatted"), F.col("loss_spans")).alias("t")).first().t
    assert got == [text for _, _, role, text in rows if role in roles]
