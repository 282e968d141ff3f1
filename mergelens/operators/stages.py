"""Features as stages of an ML pipeline, so that one stored model holds all that was fitted on train rows: bounds, order, scale, classifier.

    pipeline = training_pipeline(["churn", "files"], ml.model_of("forest"))
    model = refit(rows, pipeline)          # tuned on train, fitted anew on train and val
    model.write().overwrite().save(path)   # PipelineModel.load(path) scores alike
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.operators import grids, ml, ranks
from mergelens.storage import table


class Aligner(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """The columns inputCols of a contract as doubles, in its order and behind all other columns: a missing one, a null and NaN are 0.

    What a table has beside them stays in front, so a new table with other columns, or with the same in another order, fits a stored model."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getInputCols()
        return ml.matrix(dataset, [c for c in dataset.columns if c not in names], names)


class _Bounded(HasInputCols):
    quantile = Param(Params._dummy(), "quantile", "the quantile of the fitted rows above which values are cut", TypeConverters.toFloat)

    def getQuantile(self):
        return self.getOrDefault(self.quantile)


class Winsorizer(Estimator, _Bounded, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the upper quantile of each column of the rows it is fitted on; exact, by running counts."""

    @keyword_only
    def __init__(self, *, inputCols=None, quantile=0.99):
        super().__init__()
        self._setDefault(quantile=0.99)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> WinsorizerModel:
        names = self.getInputCols()
        found = ranks.bounds(dataset, names, self.getQuantile()).first()
        return WinsorizerModel(inputCols=names, quantile=self.getQuantile(), bounds=[float("inf") if found[c] is None else float(found[c]) for c in names])


class WinsorizerModel(Model, _Bounded, DefaultParamsReadable, DefaultParamsWritable):
    """Cuts columns at what was learned; a column without values in the fitted rows is left as it is."""

    bounds = Param(Params._dummy(), "bounds", "the largest value of each column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, quantile=0.99, bounds=None):
        super().__init__()
        self._setDefault(quantile=0.99)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pairs = zip(self.getInputCols(), self.getOrDefault(self.bounds), strict=True)
        return dataset.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.col(c).cast("double"), F.lit(most))) for c, most in pairs})


def training_pipeline(features: list[str], model, skewed: list[str] | None = None, quantile: float = 0.99) -> Pipeline:
    """Alignment, bounds of the skewed columns (all, if none are named), scale, model."""
    return Pipeline(stages=[
        Aligner(inputCols=features), Winsorizer(inputCols=skewed or features, quantile=quantile),
        VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model,
    ])


def refit(rows: DataFrame, pipeline: Pipeline, split: str = "split") -> PipelineModel:
    """The model that is stored: everything fitted anew on train and val rows together, classes weighing alike."""
    return pipeline.fit(ml.weighted(rows.where(F.col(split).isin("train", "val"))))


def training_table(figures: DataFrame, outcomes: DataFrame, splits: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, label, split and the figures of a contract in its order, as a stored table feeds a model: rows without an outcome or a split are left out, a change without
    figures has zeros."""
    joined = outcomes.select(key, "label").join(splits.select(key, "split"), key).join(figures, key, "left")
    return ml.matrix(joined, [key, "label", "split"], names)


class RandomFourier(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of a radial-basis kernel exp(-gamma |x - y|^2): their inner products estimate it, so a linear model over them stands for a model
    with that kernel, in time linear in the rows. Directions follow from the seed and the vectors' length alone, so a stored stage gives the same."""

    gamma = Param(Params._dummy(), "gamma", "the kernel's width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "how many features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the directions", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=0.1, size=256, seed=42):
        super().__init__()
        self._setDefault(gamma=0.1, size=256, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.seed))

        def features(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(grids.fourier(np.stack(vectors.to_numpy()), gamma, size, seed)))

        made = F.pandas_udf(features, "array<double>")(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(made))


def radial_svm(train: DataFrame, features: list[str], gammas: list[float], penalties: list[float], sizes: list[int] = (128, 256), folds: int = 5, seed: int = 42, rounds: int = 20, fold: Column | None = None) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """A support vector machine with a radial-basis kernel, by random Fourier features: the best of a grid by cross-validated area under the ROC curve, and every
    candidate's mean of it. 3 widths, 3 penalties and 2 sizes are 18 candidates. All candidates and folds are fitted in the same passes (see grids); `fold`, a
    row's fold from 0, is drawn where none is given."""
    drawn = F.floor(F.rand(seed) * folds) if fold is None else fold
    rows = ml.weighted(table(train.select(*features, "label", drawn.cast("int").alias("fold")), "grid"))
    grid = [(gamma, size, penalty) for gamma in map(float, gammas) for size in map(int, sizes) for penalty in map(float, penalties)]
    found = grids.cross_validated(rows, features, grid, folds, seed, rounds)
    gamma, size, penalty = grid[int(np.argmax(found))]
    fourier = RandomFourier(inputCol="scaled", outputCol="features", gamma=gamma, size=size, seed=seed)
    svm = LinearSVC(weightCol="weight", maxIter=rounds, regParam=penalty)
    whole = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), fourier, svm])
    return whole.fit(rows), [({"gamma": g, "size": n, "regParam": p}, a) for (g, n, p), a in zip(grid, found, strict=True)]
