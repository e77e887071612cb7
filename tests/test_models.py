"""Small fits: shapes, routing rules and the saved bundle."""

import pytest
from pyspark.sql import functions as F

from hammerline.functions import numbers as N
from hammerline.operators import models as M

CATS, NUMS = ["make"], ["mileage"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select((F.col("id") % 3).cast("string").alias("make"), (F.col("id") % 50).cast("double").alias("mileage"), "id")
    return df.withColumn("sold_price", 3000.0 + 9000 * F.col("make").cast("double") + 20 * F.col("mileage"))


def test_pair_and_benchmark(rows):
    out = M.benchmark(rows, rows, "sold_price", CATS, NUMS, {"linear": {}, "forest": {"numTrees": 5, "maxDepth": 4}, "raw": {"kind": "boosted", "one_hot": False, "maxIter": 3}})
    got = {r.model: r for r in out.collect()}
    assert len(got) == 9 and got["linear_linear"].MAE < 1 and got["forest_blend"].R2 > 0.9


def test_unknown_category_is_all_zeros(rows, spark):
    model = M.pipeline(CATS, []).fit(rows)
    v = model.transform(spark.createDataFrame([("unseen",)], "make string")).first().features
    assert v.size == 3 and v.numNonzeros() == 0


def test_routing(rows, spark, tmp_path):
    cls = M.train_classes(rows, "sold_price", CATS, NUMS, numTrees=5, maxDepth=4)
    experts, overall, counts = M.train_experts(rows, "sold_price", CATS, NUMS, least=150, maxIter=2, maxDepth=3)
    names = M.class_names(cls)
    df = M.with_expert_predictions(M.with_probabilities(rows, cls), experts, overall)
    out = M.soft_mixture(M.hard_routed(df, names), names)
    r = out.first()
    assert sum(r.proba) == pytest.approx(1) and r.model_used in [*names, "global"] and r.soft_pred > 0
    table = {x.segment: x for x in M.routing_table(out, "sold_price").collect()}
    assert table["ALL"].global_count == 600 and table["ALL"].hard_MAE < 2000
    assert f"proba_{names[0]}" in M.evaluation_rows(out, "sold_price", names).columns
    M.save_bundle(str(tmp_path / "b"), {"overall": overall}, {"counts": counts}, {"k": 2}, rows)
    models, tables, facts = M.load_bundle(spark, str(tmp_path / "b"))
    assert facts == {"k": 2} and tables["counts"].count() == counts.count() and "overall" in models
    imp = M.importances(overall, rows, CATS).collect()
    assert {x.base_feature for x in imp} <= {"make", "mileage"} and sum(x.importance for x in imp) == pytest.approx(1, abs=1e-6)


def test_soft_weights_fall_back_to_the_overall_model(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2], {"a": 10.0}, 100.0)], "proba array<double>, experts map<string,double>, global_pred double")
    r = M.soft_mixture(df, ["a", "b", "c"], k=2, temperature=1.0).first()
    assert r.soft_pred == pytest.approx(0.625 * 10 + 0.375 * 100) and r.soft_top1_segment == "a"
    assert N.price_class(F.lit(1)) is not None


def test_scores_from_saved_bundles(rows, spark, tmp_path):
    pair = M.fit_pair(rows, "sold_price", CATS, NUMS, "linear")
    facts = {"features": ["make", "mileage"], "linear_weight": 0.4, "log_weight": 0.6, "min_price": 0.0, "max_price": 15_000.0}
    M.save_bundle(str(tmp_path / "pair"), {"linear": pair[0], "log": pair[1]}, {}, facts, rows)
    want = {r.id: r.p_blend for r in M.predict_pair(rows, pair, (0.4, 0.6), 0.0, 15_000.0).collect()}
    got = {r.id: r.p_blend for r in M.scored_by_pair(rows.drop("sold_price"), str(tmp_path / "pair")).collect()}
    assert got == pytest.approx(want) and max(got.values()) <= 15_000
    with pytest.raises(ValueError):
        M.scored_by_pair(rows.drop("mileage"), str(tmp_path / "pair"))

    cls = M.train_classes(rows, "sold_price", CATS, NUMS, numTrees=5, maxDepth=4)
    experts, overall, counts = M.train_experts(rows, "sold_price", CATS, NUMS, least=150, maxIter=2, maxDepth=3)
    named = {c: f"expert_{k}" for k, c in enumerate(experts)}
    facts = {"features": ["make", "mileage"], "experts": named, "top_k": 2, "temperature": 0.8}
    M.save_bundle(str(tmp_path / "e"), {"classifier": cls, "overall": overall} | {named[c]: m for c, m in experts.items()}, {"counts": counts}, facts, rows)
    names = M.class_names(cls)
    direct = M.soft_mixture(M.hard_routed(M.with_expert_predictions(M.with_probabilities(rows, cls), experts, overall), names), names)
    want = {r.id: (r.soft_pred, r.hard_pred) for r in direct.collect()}
    got = {r.id: (r.soft_pred, r.hard_pred) for r in M.scored_by_experts(rows.drop("sold_price"), str(tmp_path / "e")).collect()}
    assert all(got[i] == pytest.approx(w) for i, w in want.items()) and len(got) == 600
    assert M.class_names(M.load_classifier(spark, str(tmp_path / "e"))) == names
    own = {r.segment: r for r in M.expert_metrics(rows, experts, counts, "sold_price").collect()}
    assert set(own) == set(experts) and all(r.train_count >= 150 and r.MAE >= 0 for r in own.values())
    overall.write().save(str(tmp_path / "bare"))
    assert M.load_classifier(spark, str(tmp_path / "bare")).stages
    M.save_bundle(str(tmp_path / "none"), {}, {}, {}, rows)
    with pytest.raises(ValueError):
        M.load_classifier(spark, str(tmp_path / "none"))


def test_experts_fitted_beside_one_another(rows, spark):
    from hammerline.functions.numbers import price_class

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    counted = rows.mapInArrow(seen, rows.schema)
    experts, overall, counts = M.train_experts(counted, "sold_price", CATS, NUMS, least=150, kind="linear")
    assert read.value == rows.count()  # however many models, the rows are made once
    assert len(experts) >= 2 and sum(r["count"] for r in counts.collect()) == 600
    # Trees bin their columns by the order of rows; a linear fit does not depend on it.
    one = lambda df: M.pipeline(CATS, NUMS, M.regressor("linear", labelCol="sold_price", predictionCol="p")).fit(df)
    for label, model in [*experts.items(), (None, overall)]:
        own = rows if label is None else rows.where(price_class(F.col("sold_price")) == label)
        want = {r.id: r.p for r in one(own).transform(own).collect()}
        got = {r.id: r.p for r in model.transform(own).collect()}
        assert got == pytest.approx(want, rel=1e-6)


def test_medians_by_column(spark):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, None, None), (4.0, 8, None)], "a double, b int, c double")
    assert tuple(M.median_table(df, ["a", "b", "c"]).first()) == (2.0, 6.5, 0.0)
