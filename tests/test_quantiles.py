"""Exact quantiles, by windows and by parallel selection, against plain sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hammerline.operators import prep, quantiles as Q


def plain(values, q):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    at = (len(v) - 1) * q
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    hot = [("hot", r.choice([1, 2]), r.randint(0, 4), round(r.gauss(0, 100), 1)) for _ in range(6000)]
    few = [(r.choice(["a", "b", None]), r.choice([1, None]), r.randint(0, 4), r.choice([None, 1.5, 2.0, 7.0])) for _ in range(300)]
    return hot + few + [("none", 1, 0, None), ("one", 1, 3, 5.0)] + [("same", 1, i % 5, 3.0) for i in range(2000)]


@pytest.mark.parametrize("limit", [500_000, 50])
@pytest.mark.parametrize("q", [0.5, 0.995])
def test_quantiles(spark, rows, limit, q, monkeypatch):
    monkeypatch.setattr(Q, "GROUP_ROWS", limit)
    df = spark.createDataFrame(rows, "k string, m int, fold int, v double")
    weights = {"all": F.lit(1), "rest": F.col("fold") != 2}
    got = {(r.k, r.m): (r["all"], r.rest) for r in Q.exact_quantiles(df, ["k", "m"], "v", q, weights).collect()}
    groups = {}
    for k, m, f, v in rows:
        groups.setdefault((k, m), []).append((f, v))
    for key, x in groups.items():
        want = plain([v for _, v in x], q), plain([v for f, v in x if f != 2], q)
        assert got.get(key, (None, None)) == pytest.approx(want), key
    whole = Q.exact_quantiles(df, [], "v", q, weights).first()
    assert tuple(whole) == pytest.approx((plain([x[3] for x in rows], q), plain([x[3] for x in rows if x[2] != 2], q)))


def test_empty_tables_and_own_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "k string, m int, fold int, v double")
    assert [tuple(r) for r in Q.exact_quantiles(df.limit(0), [], "v").collect()] == [(None,)]
    assert Q.exact_quantiles(df.limit(0), ["k"], "v").count() == 0
    own = Q.exact_quantiles(df, ["k"], "v", F.when(F.col("k") == "hot", 0.9).otherwise(0.1), name="q")
    assert {r.k: r.q for r in own.collect()}["hot"] == pytest.approx(plain([x[3] for x in rows if x[0] == "hot"], 0.9))


def test_out_of_fold_medians(spark, rows):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, k string, m int, fold int, v double")
    got = {r.id: r.oof for r in prep.oof_group_median(df, F.col("fold"), 5, ["k", "m"], "v", "oof").collect()}
    assert len(got) == len(rows)
    for i, (k, m, f, _) in list(enumerate(rows))[::97]:
        own = plain([v for a, b, g, v in rows if (a, b) == (k, m) and g != f], 0.5) if k is not None and m is not None else None
        assert got[i] == pytest.approx(own if own is not None else plain([v for *_, g, v in rows if g != f], 0.5))


def test_equal_values_are_stored_once(spark, monkeypatch):
    """What is written between the steps grows with the different values, not with the rows."""
    stored, kept = [], Q.fixed

    def fixed(df):
        stored.append((out := kept(df)).count())
        return out

    monkeypatch.setattr(Q, "fixed", fixed)
    monkeypatch.setattr(prep, "fixed", fixed)
    rows = spark.range(20_000).select(
        F.col("id"), F.lit("A").alias("make"), F.concat(F.lit("M"), F.col("id") % 3).alias("model"), F.lit("RED").alias("color"), F.lit(2000.0).alias("year"), F.lit(5.0).alias("mileage"),
        (1000.0 + F.col("id") % 11).alias("sold_price"), F.when(F.col("id") % 2 == 0, 1.5).alias("engine_volume"), F.lit(4.0).alias("cylinders"),
    )
    stats = prep.fit(rows)
    assert tuple(stats.numbers.first()) == (1010.0, 1.5, 4.0)
    assert {tuple(r) for r in stats.keep.collect()} == {("make", "A"), ("color", "RED"), ("model", "M0"), ("model", "M1"), ("model", "M2")}
    a, b = prep.features(rows.where("id < 15000"), rows.where("id >= 15000"), "id")
    assert a.count() == 15_000 and b.agg(F.min("make_model_year_price_median"), F.max("make_model_year_price_median")).first() == (1005.0, 1005.0)
    assert max(stored) <= 200
