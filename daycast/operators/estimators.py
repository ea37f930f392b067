"""The models as ``pyspark.ml`` stages: fit gives a model, transform predicts.

``SeriesLinearRegression`` fits one least-squares model per series, and
``SeriesBoostedTrees`` one pooled boosted model that knows each series' level. Both
are estimators with params, so a ``Pipeline``, a parameter grid or a tuner can hold
them, and both models are saved and loaded with the pipeline they are in. A model
that was not fitted refuses to predict, by name.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame

from daycast.operators import models as md
from daycast.operators.models import NotFittedError
from daycast.session import stored


class _SeriesParams(HasInputCols, HasLabelCol, HasPredictionCol):
    seriesCol = Param(Params._dummy(), "seriesCol", "column that names a row's series",
                      TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="Close", predictionCol="prediction", seriesCol="symbol")

    def getSeriesCol(self) -> str:
        return self.getOrDefault(self.seriesCol)

    def _training(self, dataset: DataFrame) -> DataFrame:
        """Series, inputs and target under the names the fits use."""
        series = self.getSeriesCol()
        if series not in dataset.columns:
            raise ValueError(f"the frame lacks the model columns {[series]}")
        return md.check_model_inputs(dataset, self.getInputCols(), self.getLabelCol())


class _ModelWriter(MLWriter):
    """Params and fitted state: only a fitted model can be written."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        self.instance._fitted()
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._save_state(self.sparkSession, f"{path}/state")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._load_state(self.sparkSession, f"{path}/state")
        return model


class _SeriesModel(Model, _SeriesParams, MLReadable, MLWritable):
    state = None

    def _fitted(self):
        if self.state is None:
            raise NotFittedError(f"{type(self).__name__} was not fitted")
        return self.state

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.state = self.state
        return that


class SeriesLinearModel(_SeriesModel):
    """Coefficients per series; a series without any keeps its rows, with a null prediction."""

    def __init__(self, coefficients: DataFrame | None = None):
        super().__init__()
        self.state = coefficients

    @property
    def coefficients(self) -> DataFrame:
        return self._fitted()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = md.ols_predict(self._fitted(), dataset, self.getInputCols(), self.getSeriesCol())
        return out.withColumnRenamed("prediction", self.getPredictionCol())

    def _save_state(self, spark, path: str) -> None:
        md.save_coefficients(self.state, path, self.getInputCols())

    def _load_state(self, spark, path: str) -> None:
        self.state, cols = md.load_coefficients(spark, path)
        if cols and cols != self.getInputCols():
            raise ValueError("the coefficients are of other columns than the params say")


class SeriesLinearRegression(Estimator, _SeriesParams, DefaultParamsReadable, DefaultParamsWritable):
    """Least squares per series, minimum-norm where inputs are collinear."""

    _input_kwargs: dict

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="Close", predictionCol="prediction", seriesCol="symbol"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SeriesLinearModel:
        data = self._training(dataset)
        coefs = md.ols_fit(data, self.getInputCols(), self.getLabelCol(), self.getSeriesCol())
        return self._copyValues(SeriesLinearModel(stored(coefs, "coefficients")))


class _TreeParams(_SeriesParams, HasMaxIter, HasStepSize, HasSeed):
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows a tree is fitted on",
                            TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "inputs looked at for a split",
                                  TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(**md.GBT_SERVICE_PARAMS)

    def tree_params(self) -> dict:
        return {name: self.getOrDefault(name) for name in md.GBT_SERVICE_PARAMS}


class SeriesBoostedModel(_SeriesModel, _TreeParams):
    """A pooled boosted model with the level and scale of each series."""

    def __init__(self, fitted: md.TreeModel | None = None):
        super().__init__()
        self.state = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = md.gbt_predict(self._fitted(), dataset.withColumnRenamed(self.getSeriesCol(), "symbol"))
        return out.withColumnRenamed("symbol", self.getSeriesCol()) \
            .withColumnRenamed("prediction", self.getPredictionCol())

    def _save_state(self, spark, path: str) -> None:
        md.save_model(self.state, spark, path)

    def _load_state(self, spark, path: str) -> None:
        self.state = md.load_model(spark, path)
        if self.state.features != self.getInputCols():
            raise ValueError("the trees are of other columns than the params say")


class SeriesBoostedTrees(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Pooled boosted trees; the defaults are the forecast service's settings."""

    _input_kwargs: dict

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="Close", predictionCol="prediction", seriesCol="symbol",
                 maxIter=200, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                 seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SeriesBoostedModel:
        data = self._training(dataset).withColumnRenamed(self.getSeriesCol(), "symbol")
        fitted = md.gbt_fit(data, self.getInputCols(), self.getLabelCol(), self.tree_params())
        return self._copyValues(SeriesBoostedModel(fitted))

