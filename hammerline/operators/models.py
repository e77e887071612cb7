"""Price models on pyspark.ml: pipelines, two-target training, price-class experts and their routing."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from hammerline.functions import numbers as N, text as X
from hammerline.operators import metrics as M
from hammerline.operators.quantiles import exact_quantiles
from hammerline.sources import tables as T
from hammerline.sources.buckets import Folder
from hammerline.sources.fix import fixed, shared_folder


def median_table(train: DataFrame, numbers: list[str]) -> DataFrame:
    """M8: exact medians of the numeric columns, one row."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("x")).select("x.*")
    found = exact_quantiles(long, ["column"], "value")
    return found.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("median"))), F.lit(0.0)).alias(f"{c}_median") for c in numbers])


def imputed(df: DataFrame, medians: DataFrame, numbers: list[str]) -> DataFrame:
    """M8: nulls to the training medians."""
    return df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_median")) for c in numbers}).drop(*[f"{c}_median" for c in numbers])


def regressor(kind: str, **settings):
    """Linear, forest, boosted or boosted_deep, with settings of the estimator."""
    if kind == "linear":
        return LinearRegression(**({"regParam": 1e-6, "solver": "normal"} | settings))
    if kind == "forest":
        return RandomForestRegressor(**({"numTrees": 300, "maxDepth": 8, "minInstancesPerNode": 2, "featureSubsetStrategy": "all", "seed": 42} | settings))
    depth = {"boosted": 6, "boosted_deep": 9}[kind]
    return GBTRegressor(**({"maxIter": 800, "stepSize": 0.05, "maxDepth": depth, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", "seed": 42} | settings))


def pipeline(categories: list[str], numbers: list[str], estimator=None, one_hot: bool = True) -> Pipeline:
    """Indexed categories, one-hot (an unknown value is all zeros) or as they are, beside the numbers."""
    index = StringIndexer(inputCols=categories, outputCols=[f"{c}_i" for c in categories], handleInvalid="keep", stringOrderType="frequencyDesc")
    stages = [index]
    inputs = [f"{c}_i" for c in categories]
    if one_hot:
        stages.append(OneHotEncoder(inputCols=inputs, outputCols=[f"{c}_v" for c in categories], dropLast=True))
        inputs = [f"{c}_v" for c in categories]
    stages.append(VectorAssembler(inputCols=[*inputs, *numbers], outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages + ([estimator] if estimator else []))


def fit_pair(train: DataFrame, target: str, categories: list[str], numbers: list[str], kind: str, one_hot: bool = True, **settings) -> tuple[PipelineModel, PipelineModel]:
    """One model of the target and one of its logarithm."""
    one = lambda label, out: pipeline(categories, numbers, regressor(kind, labelCol=label, predictionCol=out, **settings), one_hot)
    rows = train.withColumn("_log", F.log(target)).persist()
    try:
        return one(target, "p_linear").fit(rows), one("_log", "p_log").fit(rows)
    finally:
        rows.unpersist()


def predict_pair(df: DataFrame, pair: tuple[PipelineModel, PipelineModel], w: tuple[float, float] = (0.4, 0.6), lo: float = 0.0, hi: float = 100_000.0) -> DataFrame:
    """p_linear, p_log (back from logarithms) and their blend, all clipped."""
    drop = ["features"]
    out = df
    for model in pair:
        made = [c for s in model.stages[:-2] for c in (s.getOutputCols() if s.hasParam("outputCols") else [])]
        out = model.transform(out).drop(*made, *drop)
    out = out.withColumns({"p_linear": N.clip(F.col("p_linear"), lo, hi), "p_log": N.clip(F.exp("p_log"), lo, hi)})
    return out.withColumn("p_blend", N.blend(F.col("p_linear"), F.col("p_log"), *w, lo, hi))


def benchmark(train: DataFrame, test: DataFrame, target: str, categories: list[str], numbers: list[str], kinds: dict[str, dict]) -> DataFrame:
    """Three metric rows (linear, log, blend) for each kind of model."""
    rows = []
    for name, settings in kinds.items():
        kind, one_hot = settings.get("kind", name), settings.get("one_hot", True)
        settings = {k: v for k, v in settings.items() if k not in ("kind", "one_hot")}
        p = predict_pair(test, fit_pair(train, target, categories, numbers, kind, one_hot, **settings))
        rows.append(M.stacked(p, target, {f"{name}_{v}": f"p_{v}" for v in ("linear", "log", "blend")}))
    return reduce(DataFrame.unionByName, rows)


def importances(model: PipelineModel, df: DataFrame, categories: list[str]) -> DataFrame:
    """Importance per base column; the vector's metadata names its entries."""
    scored = model.transform(df.limit(0))
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    clean = lambda n: next((c for c in categories if n.startswith((f"{c}_v_", f"{c}_i"))), n)
    values = model.stages[-1].featureImportances.toArray()
    rows = [(clean(names.get(i, str(i))), float(v)) for i, v in enumerate(values)]
    return M.importance_by_base(df.sparkSession.createDataFrame(rows, "base_feature string, importance double"))


def train_classes(train: DataFrame, target: str, categories: list[str], numbers: list[str], **settings) -> PipelineModel:
    """A forest that predicts the price class from the features; the price itself is not one."""
    rows = train.withColumn("_cls", N.price_class(F.col(target))).where("_cls <> 'nan'")
    label = StringIndexer(inputCol="_cls", outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
    forest = RandomForestClassifier(**({"labelCol": "_label", "numTrees": 100, "maxDepth": 8, "seed": 42} | settings))
    return Pipeline(stages=[label, *pipeline(categories, numbers).getStages(), forest]).fit(rows)


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def with_probabilities(df: DataFrame, model: PipelineModel) -> DataFrame:
    """An array of class probabilities, in the order of class_names."""
    out = df
    for stage in model.stages[1:]:
        out = stage.transform(out)
    return out.select(*df.columns, vector_to_array("probability").alias("proba"))


def train_experts(train: DataFrame, target: str, categories: list[str], numbers: list[str], least: int = 150, kind: str = "boosted", at_once: int = 4, **settings) -> tuple[dict[str, PipelineModel], PipelineModel, DataFrame]:
    """A regressor for each price class with enough rows, one of all rows, and the classes' counts.

    The rows are made once, as a table in the shared folder with a folder for each
    class, so an expert reads its own class alone; up to `at_once` fits run beside
    one another and share the cluster.
    """
    spark = train.sparkSession
    name = f"experts-{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    # The class twice: a folder's name would be read back as another type.
    train.withColumns({"_cls": N.price_class(F.col(target)), "_of": N.price_class(F.col(target))}).write.partitionBy("_of").parquet(folder)
    rows = spark.read.schema(f"{_kinds(train)}, `_cls` string, `_of` string").parquet(folder)
    counts = fixed(rows.groupBy("_of").agg(F.count(F.lit(1)).alias("count")).select(F.col("_of").alias("segment"), "count"))
    # The classes are the few that the price edges make.
    wanted = [r["segment"] for r in counts.where((F.col("count") >= least) & (F.col("segment") != "nan")).orderBy("segment").collect()]

    def fit(label: str | None) -> PipelineModel:
        own = rows if label is None else rows.where(F.col("_of") == label)
        return pipeline(categories, numbers, regressor(kind, labelCol=target, predictionCol="p", **settings)).fit(own)

    with ThreadPool(max(1, at_once)) as pool:
        overall, *fitted = pool.map(inheritable_thread_target(spark)(fit), [None, *wanted])
    Folder(spark, folder).remove("")
    return dict(zip(wanted, fitted, strict=True)), overall, counts


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def with_expert_predictions(df: DataFrame, experts: dict[str, PipelineModel], overall: PipelineModel) -> DataFrame:
    """`global_pred` and a map column from class to its expert's prediction, all in one plan."""
    out, made = df, {}
    for k, (label, model) in enumerate([("", overall), *experts.items()]):
        names = out.columns
        out = model.transform(out).select(*names, F.col("p").alias(f"_e{k}"))
        made[label] = F.col(f"_e{k}")
    table = F.create_map(*[x for label, p in made.items() if label for x in (F.lit(label), p)]) if len(made) > 1 else F.create_map().cast("map<string,double>")
    return out.withColumns({"experts": table, "global_pred": made[""]}).select(*df.columns, "experts", "global_pred")


def expert_for(label: Column) -> Column:
    """The class's expert, or the overall model where it has none."""
    return F.coalesce(F.try_element_at("experts", label), F.col("global_pred"))


def hard_routed(df: DataFrame, names: list[str]) -> DataFrame:
    """The prediction of the likeliest class's expert, and which model was used."""
    label = F.element_at(F.array(*[F.lit(n) for n in names]), N.first_max(F.col("proba")) + 1)
    used = F.when(F.try_element_at("experts", label).isNull(), "global").otherwise(label)
    return df.withColumns({"hard_pred": expert_for(label), "hard_pred_segment": label, "model_used": used})


def soft_mixture(df: DataFrame, names: list[str], k: int = 2, temperature: float = 0.8) -> DataFrame:
    """Expert predictions weighted by the k largest tempered probabilities, with top class and entropy."""
    p = N.softened(F.col("proba"), temperature)
    out = df.withColumn("_p", p)
    w = N.top_k(F.col("_p"), k)
    preds = F.array(*[expert_for(F.lit(n)) for n in names])
    out = out.withColumns({"_w": w, "_x": preds, "routing_entropy": N.entropy(F.col("_p"))})
    total = F.aggregate(F.zip_with("_w", "_x", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    top = F.element_at(F.array(*[F.lit(n) for n in names]), N.first_max(F.col("_p")) + 1)
    return out.withColumns({"soft_pred": total, "soft_top1_segment": top}).drop("_p", "_w", "_x")


def routing_table(df: DataFrame, target: str) -> DataFrame:
    """Overall and per-class metrics of global, hard and soft predictions; the row of all has segment ALL."""
    names = {"global": "global_pred", "hard": "hard_pred", "soft": "soft_pred"}
    rows = df.withColumn("segment", N.price_class(F.col(target)))
    tables = {n: M.by_segment(rows, "segment", target, p).unionByName(M.by_segment(rows.withColumn("segment", F.lit("ALL")), "segment", target, p)) for n, p in names.items()}
    return M.joined_by_segment(tables, "segment")


def evaluation_rows(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    """Predictions, absolute errors and one probability column per class."""
    errors = {f"{n}_abs_error": F.abs(F.col(target) - F.col(f"{n}_pred")) for n in ("global", "hard", "soft")}
    return df.withColumns(errors | {f"proba_{n}": F.col("proba")[i] for i, n in enumerate(names)})


def save_bundle(path: str, models: dict[str, PipelineModel], tables: dict[str, DataFrame], facts: dict, df: DataFrame) -> None:
    """Models, statistics tables and one JSON row under one folder."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    index = json.dumps({"models": sorted(models), "tables": sorted(tables), "facts": facts})
    df.sparkSession.createDataFrame([(index,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/index")


def load_bundle(spark, path: str) -> tuple[dict[str, PipelineModel], dict[str, DataFrame], dict]:
    """What save_bundle wrote; a folder that is a bare model loads as {"model": it}."""
    try:
        index = json.loads(spark.read.text(f"{path}/index").first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {"model": PipelineModel.load(path)}, {}, {}
    return {n: PipelineModel.load(f"{path}/models/{n}") for n in index["models"]}, {n: spark.read.parquet(f"{path}/tables/{n}") for n in index["tables"]}, index["facts"]


def load_classifier(spark, path: str) -> PipelineModel:
    """The classifier of a bundle, by the name classifier or else model, or the bare model of the folder."""
    models, _, _ = load_bundle(spark, path)
    for name in ("classifier", "model"):
        if name in models:
            return models[name]
    raise ValueError(f"no classifier in {path}")


def expert_metrics(test: DataFrame, experts: dict[str, PipelineModel], counts: DataFrame, target: str) -> DataFrame:
    """Each expert on the test rows of its own class, with train_count; classes without test rows have no row."""
    rows = test.withColumn("segment", N.price_class(F.col(target))).where(F.col("segment").isin(list(experts)))
    own = [M.by_segment(model.transform(rows.where(F.col("segment") == label)), "segment", target, "p") for label, model in experts.items()]
    if not own:
        raise ValueError("no experts")
    return reduce(DataFrame.unionByName, own).join(F.broadcast(counts.withColumnRenamed("count", "train_count")), "segment")


def scored_by_pair(df: DataFrame, path: str) -> DataFrame:
    """Rows with both component predictions and their blend, by the bundle of a pair.

    The bundle has models linear and log, and as facts features, linear_weight, log_weight, min_price and max_price.
    """
    models, _, facts = load_bundle(df.sparkSession, path)
    rows = T.require_columns(df, facts["features"])
    weights = (facts["linear_weight"], facts["log_weight"])
    return predict_pair(rows, (models["linear"], models["log"]), weights, facts["min_price"], facts["max_price"])


def scored_by_experts(df: DataFrame, path: str) -> DataFrame:
    """Rows with the soft and the hard routed price, by the bundle of classifier, experts and overall model.

    The bundle has models classifier, overall and expert_<k>, and as facts features, experts (class to model name), top_k
    (null: all classes) and temperature. A null category is UNKNOWN; no secondary damage is NONE.
    """
    models, _, facts = load_bundle(df.sparkSession, path)
    rows = T.require_columns(df, facts["features"])
    texts = {c: F.coalesce(c, F.lit("UNKNOWN")) for c, kind in rows.dtypes if kind == "string" and c in facts["features"]}
    if "secondary_damage" in texts:
        texts["secondary_damage"] = F.when(texts["secondary_damage"] == "UNKNOWN", "NONE").otherwise(texts["secondary_damage"])
    names = class_names(models["classifier"])
    routed = with_expert_predictions(with_probabilities(rows.withColumns(texts) if texts else rows, models["classifier"]), {c: models[m] for c, m in facts["experts"].items()}, models["overall"])
    return soft_mixture(hard_routed(routed, names), names, facts.get("top_k") or len(names), facts.get("temperature") or 1.0)


def base_column(c: Column, categories: list[str]) -> Column:
    return X.base_feature(c, categories)
