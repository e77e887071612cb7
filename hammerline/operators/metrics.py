"""Evaluation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def regression_metrics(y: str, p: str, r2: bool = True) -> list[Column]:
    """Aggregates MAE, RMSE, R2 (null for fewer than two rows) and shares within 10, 20, 30 percent."""
    e = F.col(y) - F.col(p)
    # Var_pop times n is the total sum of squares, without a second pass over the rows.
    r = F.when((F.count(y) > 1) & (F.var_pop(y) > 0), 1 - F.sum(e * e) / (F.var_pop(y) * F.count(y)))
    within = lambda w: F.avg(F.when(F.col(y) != 0, (F.abs(e) / F.abs(y) <= w).cast("double")))
    out = [F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE")]
    return out + ([r.alias("R2")] if r2 else []) + [within(w / 100).alias(f"ACC_{w}") for w in (10, 20, 30)]


def by_segment(df: DataFrame, segment: str, y: str, p: str) -> DataFrame:
    """Count, MAE, RMSE and R2 per segment."""
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("count"), *regression_metrics(y, p)[:3])


def compared_by_segment(df: DataFrame, segment: str, y: str, predictions: dict[str, str]) -> DataFrame:
    """MAE and RMSE of several predictions per segment, from one aggregation."""
    cols = [F.count(F.lit(1)).alias("count")]
    for name, p in predictions.items():
        e = F.col(y) - F.col(p)
        cols += [F.avg(F.abs(e)).alias(f"{name}_MAE"), F.sqrt(F.avg(e * e)).alias(f"{name}_RMSE")]
    return df.groupBy(segment).agg(*cols)


def stacked(df: DataFrame, y: str, predictions: dict[str, str]) -> DataFrame:
    """One row of metrics per prediction column, from one pass over long rows."""
    long = df.select(F.col(y).alias("_y"), F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("_p")) for n, c in predictions.items()])).alias("x")).select("_y", "x.*")
    return long.groupBy("model").agg(*regression_metrics("_y", "_p"))


def leaderboard(metrics: DataFrame, by: str = "MAE") -> DataFrame:
    """The best first."""
    return metrics.orderBy(F.asc(by), "model")


def best(metrics: DataFrame, by: str = "MAE") -> DataFrame:
    """The best row, its name decoded to model and variant."""
    top = leaderboard(metrics, by).limit(1)
    part = lambda i: F.regexp_extract("model", r"^(.*)_(linear|log|blend)$", i)
    return top.withColumns({"base_model": F.coalesce(F.nullif(part(1), F.lit("")), F.col("model")), "variant": F.nullif(part(2), F.lit(""))})


def class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class and their macro and weighted means, from one confusion count.

    Divisions by zero give 0; the accuracy is the weighted recall.
    """
    cells = df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hit")])
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumns({"precision": div(F.col("hit"), F.col("claimed")), "recall": div(F.col("hit"), F.col("support"))})
    per = per.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("cls"), *[F.avg(c).alias(c) for c in names], total.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("cls"), *[F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names], total.alias("support"))
    return reduce(DataFrame.unionByName, [per.select(F.col("cls").cast("string").alias("cls"), *names, "support"), macro, weighted])


def importance_by_base(importances: DataFrame) -> DataFrame:
    """Summed importance per base feature, largest first."""
    return importances.groupBy("base_feature").agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"), "base_feature")


def prefixed(df: DataFrame, prefix: str, keep: list[str] = ()) -> DataFrame:
    """All other columns with a prefix."""
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def joined_by_segment(tables: dict[str, DataFrame], segment: str) -> DataFrame:
    """Metric tables side by side; a segment that any has is there."""
    return reduce(lambda a, b: a.join(b, segment, "full_outer"), [prefixed(t, f"{n}_", [segment]) for n, t in tables.items()])
