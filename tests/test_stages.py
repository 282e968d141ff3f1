"""Stages that are stored with a model: bounds, alignment, refit on train and val."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from mergelens.operators import ml, stages


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 7 % 100).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("b"), F.when(F.col("id") * 7 % 100 > 40, 1).otherwise(0).alias("label"), F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 < 8, "val").otherwise("test").alias("split"))


def test_bounds_come_from_fitted_rows_only(rows):
    some = rows.where("k < 100").select("k", "a", "b", F.lit(None).cast("int").alias("none"))
    model = stages.Winsorizer(inputCols=["a", "b", "none"], quantile=0.5).fit(some)
    assert model.getOrDefault(model.bounds) == [49.5, 5.0, float("inf")]
    found = model.transform(rows.withColumn("none", F.lit(3))).toPandas()
    assert found.a.max() == 49.5 and found.b.max() == 5.0 and (found.none == 3).all() and found.b.isna().sum() == 60


def test_alignment_takes_any_table(rows):
    found = stages.Aligner(inputCols=["z", "b", "a"]).transform(rows.select("b", "label", "a"))
    assert found.columns == ["label", "z", "b", "a"]
    assert found.where("z <> 0 or b is null").count() == 0


@pytest.mark.parametrize("kind", ["logistic", "forest"])
def test_a_stored_model_scores_alike_and_learned_from_train_and_val(rows, tmp_path, kind):
    pipeline = stages.training_pipeline(["a", "b"], ml.model_of(kind), ["a"], 0.9)
    model = stages.refit(rows, pipeline)
    assert model.stages[1].getOrDefault("bounds") == [pytest.approx(float(rows.where("split <> 'test'").toPandas().a.quantile(0.9)))]
    model.write().overwrite().save(str(tmp_path / "m"))
    test = rows.where("split = 'test'").select("label", "b", "k", "a")  # another order, and a column less
    own = {r.k: r.score for r in ml.scored(model, test, "k").collect()}
    again = {r.k: r.score for r in ml.scored(PipelineModel.load(str(tmp_path / "m")), test.withColumn("more", F.lit(1)), "k").collect()}
    assert own == again and len(own) == 60
    assert sum((own[r.k] > 0.5) == r.label for r in test.collect()) >= 55


def test_training_table(spark, rows):
    figures = rows.where("k > 10").select("k", "a", "b")
    found = stages.training_table(figures, rows, rows, "k", ["b", "z", "a"])
    assert found.columns == ["k", "label", "split", "b", "z", "a"] and found.count() == 300
    assert tuple(found.where("k = 3").first())[3:] == (0.0, 0.0, 0.0)


def test_fourier_features_estimate_the_kernel(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(1).normal(size=(20, 3))
    rows = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], ["i", "v"])
    stage = stages.RandomFourier(inputCol="v", outputCol="f", gamma=0.3, size=4000)
    f = np.stack([r.f.toArray() for r in stage.transform(rows).orderBy("i").collect()])
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert abs(f @ f.T - kernel).max() < 0.08


def test_two_rings_need_the_kernel(spark, tmp_path):
    import math
    import random

    r = random.Random(3)
    points = []
    for i in range(300):
        radius, angle = (1 if i % 2 else 3) + r.gauss(0, 0.2), r.uniform(0, 2 * math.pi)
        points.append((i, radius * math.cos(angle), radius * math.sin(angle), i % 2))
    rows = spark.createDataFrame(points, "k int, x double, y double, label int").cache()
    model, tried = stages.radial_svm(rows.where("k < 200"), ["x", "y"], [0.5, 1.0], [0.01], [64], folds=3)
    assert len(tried) == 2 and max(a for _, a in tried) > 0.98
    model.write().overwrite().save(str(tmp_path / "m"))
    held = rows.where("k >= 200")
    right = lambda m: ml.scored(m, held, "k").where("label = guess").count()
    assert right(PipelineModel.load(str(tmp_path / "m"))) >= 97 and right(ml.fit(rows.where("k < 200"), ["x", "y"], "svm")) < 85


def test_a_grid_is_fitted_in_few_passes_and_as_one_by_one(spark):
    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    x = np.random.default_rng(5).normal(size=(240, 2))
    points = [(i, float(a), 3 * float(b), 0.0, int(a * a + b > 0.8)) for i, (a, b) in enumerate(x)]
    rows = spark.createDataFrame(points, "k int, x double, y double, none double, label int").withColumn("fold", F.col("k") % 3).cache()
    names, gammas, penalties, sizes = ["x", "y", "none"], [0.05, 1.0], [0.001, 0.1], [16, 32]
    spark.sparkContext.setJobGroup("grid", "grid")
    _, tried = stages.radial_svm(rows, names, gammas, penalties, sizes, folds=3, rounds=8, fold=F.col("fold"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid")) < 120  # one by one takes a job for each step of each of 24 machines

    fourier, svm = stages.RandomFourier(inputCol="scaled", outputCol="features"), LinearSVC(weightCol="weight", maxIter=8)
    whole = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), fourier, svm])
    grid = ParamGridBuilder().addGrid(fourier.gamma, gammas).addGrid(fourier.size, sizes).addGrid(svm.regParam, penalties).build()
    judge = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label", numBins=0)
    single = CrossValidator(estimator=whole, estimatorParamMaps=grid, evaluator=judge, numFolds=3, foldCol="fold").fit(ml.weighted(rows))
    assert [c for c, _ in tried] == [{p.name: v for p, v in c.items()} for c in grid]
    assert [a for _, a in tried] == [pytest.approx(float(a), abs=1e-9) for a in single.avgMetrics]


def test_a_held_out_fold_of_one_class_counts_as_nothing_or_all(spark):
    points = [(float(i), i % 2, 0) for i in range(30)] + [(float(i), 1, 1) for i in range(5)] + [(float(i), 0, 2) for i in range(5)]
    rows = spark.createDataFrame(points, "x double, label int, fold int")
    _, tried = stages.radial_svm(rows, ["x"], [0.5], [0.01], [8], folds=3, rounds=2, fold=F.col("fold"))
    assert 1 / 3 <= tried[0][1] <= 2 / 3  # 1 for all of label 1, 0 for none, and the mixed fold's own
