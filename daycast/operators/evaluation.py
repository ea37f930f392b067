"""Forecast-vs-actual scoring at day, model and any coarser grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.functions.values import mae, mape, rmse


def forecast_vs_actual(current: DataFrame, bars: DataFrame) -> DataFrame:
    """Inner equi-join of forecast rows with the actual Close of the same
    (symbol, day), for every day at once. Both sides are keyed by
    (symbol, date); AQE picks broadcast only when a side is measured small."""
    actual = bars.select("symbol", F.col("Date").alias("target_date"),
                         F.col("Close").alias("actual"))
    return (current.join(actual, ["symbol", "target_date"], "inner")
                   .select("symbol", "model", "target_date", "run_date", "actual",
                           F.col("prediction").alias("predicted")))


def day_metrics(fva: DataFrame) -> DataFrame:
    """Per (symbol, model, day): the one-day MAE, RMSE (= MAE) and MAPE
    (null when the actual is 0)."""
    err = F.col("actual") - F.col("predicted")
    return fva.select(
        "symbol", "model", F.col("target_date").alias("date"), "actual", "predicted",
        F.abs(err).alias("MAE"),
        F.sqrt(err * err).alias("RMSE"),
        F.when(F.col("actual") != 0,
               F.abs(F.try_divide(err, F.col("actual"))) * F.lit(100.0)).alias("MAPE"))


def match_day(df: DataFrame, day, col: str = "target_date") -> DataFrame:
    """Rows of one day (pushed down to the scan when df reads Parquet)."""
    return df.where(F.col(col) == F.lit(day))


def metrics_for_day(fva: DataFrame, model: str, day) -> DataFrame:
    """The one-day scorecard of a model (per symbol): actual, predicted,
    MAE, RMSE, MAPE of ``day`` — typically the day before as_of."""
    return day_metrics(match_day(fva.where(F.col("model") == model), day))


def model_report(fva: DataFrame, grain: list[str] | None = None) -> DataFrame:
    """MAE / RMSE / MAPE per model (and symbol), optionally at a coarser
    time grain, e.g. ``grain=['month']``. Partial aggregation map-side."""
    keys = ["symbol", "model"]
    df = fva
    if grain and "month" in grain:
        df = df.withColumn("month", F.trunc("target_date", "month"))
        keys.append("month")
    y, p = F.col("actual"), F.col("predicted")
    return df.groupBy(*keys).agg(mae(y, p).alias("MAE"), rmse(y, p).alias("RMSE"),
                                 mape(y, p).alias("MAPE"),
                                 F.count(F.lit(1)).alias("days"))


def _models(current: DataFrame, models: list[str] | None) -> list[str]:
    """The models asked for, else those of the frame (a handful of names)."""
    if models is not None:
        return list(models)
    return sorted(r["model"] for r in current.select("model").where("model IS NOT NULL").distinct().collect())


def compare_models(current: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(symbol, target_date, one prediction column per model); a model without a row for
    a day is null there."""
    return (current.groupBy("symbol", "target_date").pivot("model", _models(current, models))
            .agg(F.max("prediction")))


def overlay_history_forecast(bars: DataFrame, current: DataFrame, models: list[str] | None = None,
                             target: str = "Close", since=None) -> DataFrame:
    """(symbol, date, value, series): actual values and the models' forecasts under one
    another, from the day ``since`` on if given."""
    if models is not None:
        current = current.where(F.col("model").isin(list(models)))
    out = bars.select("symbol", F.col("Date").alias("date"), F.col(target).alias("value"),
                      F.lit("actual").alias("series")) \
        .unionByName(current.select("symbol", F.col("target_date").alias("date"), F.col("prediction").alias("value"),
                                    F.col("model").alias("series")))
    return out if since is None else out.where(F.col("date") >= F.lit(since))
