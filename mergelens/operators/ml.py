"""Features and classifiers: bounds and scales fitted on train rows, classes that weigh alike, grids, ablation, stored models.

Rows hold a key, `label` (0 or 1) and `split` (train, val or test); where a function asks for no split column, pass the one to use.
A radial-basis SVM has no counterpart in MLlib and is not offered.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.operators import ranks


def weighted(rows: DataFrame, label: str = "label") -> DataFrame:
    """Each class has half of all weight."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))  # two rows
    total = counts.agg(F.sum("_n").alias("_t"))
    return rows.join(F.broadcast(counts), label).join(F.broadcast(total)).withColumn("weight", F.col("_t") / (2.0 * F.col("_n"))).drop("_n", "_t")


def winsorize(rows: DataFrame, columns: list[str], train: Column, quantile: float = 0.99) -> DataFrame:
    """Columns cut at the upper quantile of the train rows; one row of bounds is broadcast."""
    bounds = ranks.bounds(rows.where(train), columns, quantile).withColumnsRenamed({c: f"_{c}" for c in columns})
    return rows.join(F.broadcast(bounds)).withColumns({c: F.least(F.col(c).cast("double"), F.coalesce(F.col(f"_{c}"), F.col(c).cast("double"))) for c in columns}).drop(*[f"_{c}" for c in columns])


def matrix(rows: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """keep and the columns in the order given, as doubles: a missing column, a null and NaN are 0."""
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    return rows.select(*keep, *[value(c).alias(c) for c in columns])


def majority(rows: DataFrame, train: Column) -> DataFrame:
    """Every row's guess is the commonest label of the train rows (the smaller one on a tie) and its score that label's share of 1."""
    most = rows.where(train).agg(F.coalesce((F.avg("label") > 0.5).cast("int"), F.lit(0)).alias("guess"))
    return rows.join(F.broadcast(most)).withColumn("score", F.col("guess").cast("double"))


def model_of(kind: str, **options):
    if kind == "logistic":
        return LogisticRegression(weightCol="weight", maxIter=50, **options)
    if kind == "svm":
        return LinearSVC(weightCol="weight", **({"maxIter": 30, "regParam": 0.01} | options))
    return RandomForestClassifier(weightCol="weight", **({"numTrees": 50, "maxDepth": 8, "seed": 42} | options))


def pipeline(features: list[str], model) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model])


def fit(train: DataFrame, features: list[str], kind: str = "forest", **options) -> PipelineModel:
    return pipeline(features, model_of(kind, **options)).fit(weighted(train))


def scored(model: PipelineModel, rows: DataFrame, *keep: str) -> DataFrame:
    """score: the probability of label 1, or for an SVM its distance on the label's side."""
    out = model.transform(rows)
    value = vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]
    return out.select(*keep, "label", F.round(value, 6).alias("score"), F.col("prediction").cast("int").alias("guess"))


def searched(train: DataFrame, features: list[str], kind: str, grid: dict[str, list], folds: int = 5, parallelism: int = 2, seed: int = 42) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """The best model of a grid by cross-validated area under the ROC curve, and every candidate's mean of it."""
    model = model_of(kind)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), values)
    candidates = builder.build()
    judge = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label")
    fitted = CrossValidator(estimator=pipeline(features, model), estimatorParamMaps=candidates, evaluator=judge, numFolds=folds, parallelism=parallelism, seed=seed).fit(weighted(train))
    return fitted.bestModel, [({p.name: v for p, v in c.items()}, m) for c, m in zip(candidates, fitted.avgMetrics, strict=True)]


def importances(model: PipelineModel, features: list[str], n: int = 20) -> list[tuple[str, float]]:
    """The n most important features of a forest; ties by name."""
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def ablation(rows: DataFrame, train: Column, test: Column, groups: dict[str, list[str]], kind: str = "forest", **options) -> list[tuple[str, int, float]]:
    """Area under the ROC curve on test rows for models of each group of features."""
    judge = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label")
    found = []
    for name, features in groups.items():
        model = fit(rows.where(train), features, kind, **options)
        found.append((name, len(features), judge.evaluate(model.transform(rows.where(test)))))
    return found


def save(model: PipelineModel, features: list[str], path: str) -> None:
    """The model, and beside it the contract: the features' names in order, as a table of one row of text."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({"features": features}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load(spark: SparkSession, path: str, features: list[str]) -> PipelineModel:
    """The stored model; an error where its names are not exactly these, in this order."""
    contract = json.loads(spark.read.text(f"{path}/contract").first()[0])["features"]
    if contract != features:
        raise ValueError(f"the model takes {contract}, not {features}")
    return PipelineModel.load(f"{path}/model")


def logistic_scores(rows: DataFrame, features: list[str], train: Column | None = None) -> DataFrame:
    own = F.col("doc_id") % 10 < 7 if train is None else train
    return scored(fit(rows.where(own), features, "logistic"), rows, "doc_id").drop("guess")


def forest_scores(rows: DataFrame, features: list[str], trees: int = 50, depth: int = 8, seed: int = 42, train: Column | None = None) -> DataFrame:
    own = F.col("doc_id") % 10 < 7 if train is None else train
    return scored(fit(rows.where(own), features, "forest", numTrees=trees, maxDepth=depth, seed=seed), rows, "doc_id").drop("guess")
