"""Repaired conversations against a plain search over one turn and state at a time."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute as B

KIND = "conv_id long, turn long, role string, text string, n long, at long, symbol string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _check(df, rows):
    from hammerline.llm.conversations import repair_conversations

    out = repair_conversations(df)
    assert out.columns == COLUMNS
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    want = B.repaired(rows)
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert got[c] == w, c


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_supplied_conversations(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    _check(df, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def _made(seed, convs, turns):
    r = random.Random(seed)
    texts = ["Hello there.", "Yes!", "no end", "cut off. But on", " ", "", None, "Why?", "one. \n", "\t\n", "é.", "a b c?"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "unknown", "Assistant"]
    out = []
    for c in range(convs):
        for t in range(r.randint(1, turns)):
            out.append((c if c else None, r.choice([t, t, t, t + 3, None]) if r.random() < 0.3 else t, r.choice(roles) if r.random() < 0.4 else ("user", "assistant")[t % 2], r.choice(texts) if r.random() < 0.5 else f"text {r.randint(0, 40)}."))
    return out


def test_awkward_conversations(spark):
    rows = _made(3, 600, 14)
    df = spark.createDataFrame([(*x, 1, 2, "x") for x in rows], KIND)
    _check(df, rows)
    _check(df.limit(0), [])


def test_a_conversation_over_many_partitions(spark):
    r = random.Random(8)
    rows = [(7, t, ("user", "assistant")[t % 2] if r.random() < 0.8 else r.choice(["user", "system", "other"]), "again." if r.random() < 0.1 else f"turn {t}" + "." * (r.random() < 0.7)) for t in range(6000)]
    rows += [(7, 9000, "user", "one and the same.")] * 500 + _made(4, 20, 9)
    rows += [(8, t, "user", f"{t}.") for t in range(3000)]  # one long run
    df = spark.createDataFrame([(*x, 1, 2, "x") for x in rows], KIND)
    from hammerline.llm.conversations import damaged, repaired_turns

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check(df, rows)
        parts = {(x[0], x[1]) for x in repaired_turns(damaged(df)).where("split").select("conv_id", F.shiftright("at", 33)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([c for c, _ in parts if c == 7]) > 2 and len([c for c, _ in parts if c == 8]) > 1


def test_runs_by_powers_are_single_steps():
    from hammerline.llm.conversations import matrix, unroll

    r = random.Random(1)
    for _ in range(300):
        runs = tuple((s, n) for s, n in ((r.choice("suaoSUAOx"), r.choice([1, 1, 2, 3, 5, 8, 13])) for _ in range(r.randint(1, 5))))
        single = tuple((s, 1) for s, n in runs for _ in range(n))
        assert matrix(runs) == matrix(single)
        assert unroll(runs) == unroll(single)
    audit, state = unroll((("u", 1_000_000),))
    assert len(audit) >= 1_000_000 and state == 3
