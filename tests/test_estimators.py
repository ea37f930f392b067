"""Models as pyspark.ml stages: pipelines, grids, round trips, refusals."""
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

from daycast.operators import models as md
from daycast.operators.estimators import (NotFittedError, SeriesBoostedModel, SeriesBoostedTrees,
                                          SeriesLinearModel, SeriesLinearRegression)

SMALL = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.3, "seed": 1}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 2))
    made = [("ab"[k % 2], *map(float, v), float((k % 2) * 10 + v @ [2.0, -1.0 - k % 2])) for k, v in enumerate(x)]
    return spark.createDataFrame(made, "series string, p double, q double, price double").cache()


def predictions(df):
    return [r.prediction for r in df.orderBy("p", "q").collect()]


def linear(**kw):
    return SeriesLinearRegression(inputCols=["p", "q"], labelCol="price", seriesCol="series", **kw)


def test_linear_in_a_pipeline_survives_save_and_load(spark, rows, tmp_dir):
    square = SQLTransformer(statement="SELECT *, p * q AS pq FROM __THIS__")
    fit = SeriesLinearRegression(inputCols=["p", "q", "pq"], labelCol="price", seriesCol="series")
    pipeline = Pipeline(stages=[square, fit])
    pipeline.write().overwrite().save(f"{tmp_dir}/unfitted")
    model = Pipeline.load(f"{tmp_dir}/unfitted").fit(rows)
    out = model.transform(rows)
    np.testing.assert_allclose(predictions(out), [r.price for r in rows.orderBy("p", "q").collect()], atol=1e-9)
    model.write().overwrite().save(f"{tmp_dir}/fitted")
    again = PipelineModel.load(f"{tmp_dir}/fitted")
    assert predictions(again.transform(rows)) == predictions(out)
    stage = again.stages[-1]
    assert isinstance(stage, SeriesLinearModel) and stage.getInputCols() == ["p", "q", "pq"]
    assert {r.symbol: r.n_rows for r in stage.coefficients.collect()} == {"a": 60, "b": 60}


def test_boosted_round_trip_equals_the_function(spark, rows, tmp_dir):
    fit = SeriesBoostedTrees(inputCols=["p", "q"], labelCol="price", seriesCol="series", predictionCol="guess", **SMALL)
    model = fit.fit(rows)
    out = [r.guess for r in model.transform(rows).orderBy("p", "q").collect()]
    named = rows.withColumnRenamed("series", "symbol")
    plain = md.gbt_fit(named, ["p", "q"], "price", {**md.GBT_SERVICE_PARAMS, **SMALL})
    np.testing.assert_allclose(out, predictions(md.gbt_predict(plain, named)))
    model.save(f"{tmp_dir}/m")
    again = SeriesBoostedModel.load(f"{tmp_dir}/m")
    assert again.getMaxDepth() == 2 if hasattr(again, "getMaxDepth") else again.getOrDefault("maxDepth") == 2
    assert [r.guess for r in again.transform(rows).orderBy("p", "q").collect()] == out


def test_a_grid_holds_them(spark, rows):
    fit = SeriesBoostedTrees(inputCols=["p", "q"], labelCol="price", seriesCol="series", **SMALL)
    grid = ParamGridBuilder().addGrid(fit.maxIter, [1, 8]).build()
    search = TrainValidationSplit(estimator=fit, estimatorParamMaps=grid, seed=3, parallelism=2,
                                  evaluator=RegressionEvaluator(labelCol="price", metricName="mae"))
    found = search.fit(rows)
    assert found.validationMetrics[1] < found.validationMetrics[0]
    assert found.bestModel.getMaxIter() == 8


def test_models_that_were_not_fitted_refuse(spark, rows, tmp_dir):
    for model in (SeriesLinearModel(), SeriesBoostedModel()):
        with pytest.raises(NotFittedError, match=type(model).__name__):
            model.transform(rows)
        with pytest.raises(NotFittedError):
            model.save(f"{tmp_dir}/none")
    with pytest.raises(NotFittedError):
        md.gbt_predict(None, rows)
    with pytest.raises(NotFittedError):
        md.ols_predict(None, rows, ["p"])


def test_inputs_are_checked(spark, rows):
    with pytest.raises(ValueError, match="nope"):
        SeriesLinearRegression(inputCols=["nope"], labelCol="price", seriesCol="series").fit(rows)
    with pytest.raises(ValueError, match="symbol"):
        SeriesLinearRegression(inputCols=["p"], labelCol="price").fit(rows)
    with pytest.raises(ValueError, match="no rows"):
        linear().fit(rows.limit(0))
    model = linear().fit(rows)
    with pytest.raises(ValueError, match="q"):
        model.transform(rows.drop("q"))
    # a series that was not seen keeps its rows
    new = spark.createDataFrame([("new", 1.0, 2.0, 0.0)], rows.schema)
    assert model.transform(new).first().prediction is None
