"""Registered queries: model fit / predict, cross-validation, tree forecasts.

Fits on two lags, and a single split, are checked against closed forms in SQL; the
fits on all features have no SQL twin and are tested against NumPy on small frames.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daycast.operators import features as feat
from daycast.operators import models as md
from daycast.operators.forecast import LAG_COLS, training_frame
from daycast.operators.tree_forecast import direct_forecast_gbt, recursive_forecast_gbt
from daycast.plans import common
from daycast.plans import oracle as O
from daycast.plans.forecast_q import lag_rows_cte, ols2, window_cte

AS_OF = common.AS_OF
TEST_FROM = AS_OF - dt.timedelta(days=365)     # last year of history is held out
YEAR = 365
HORIZONS = [1, 7, 30, 90, 180, 365]
STUMP_PARAMS = {"maxIter": 1, "maxDepth": 1, "seed": 42}


def _features(spark, sf_dir, causal: bool = False):
    """The feature table, computed once for plans that read it more than once."""
    ft = feat.feature_table(common.bars(spark, sf_dir), common.calendar())
    return common.materialize(feat.causal_features(ft) if causal else ft)


def _ols_fit_predict(spark, sf_dir, causal: bool):
    ft = _features(spark, sf_dir, causal)
    cols = feat.feature_columns(ft)
    coefs = md.ols_fit(ft.where(F.col("Datetime") < F.lit(TEST_FROM)), cols)
    pred = md.ols_predict(coefs, ft.where(F.col("Datetime") >= F.lit(TEST_FROM)), cols)
    return common.round_doubles(pred.select("symbol", "Datetime", "Close", "prediction"), 2)


def q_ols_fit_predict(spark, sf_dir):
    return _ols_fit_predict(spark, sf_dir, causal=False)


def q_ols_fit_predict_causal(spark, sf_dir):
    return _ols_fit_predict(spark, sf_dir, causal=True)


def q_ols_fit_lags(spark, sf_dir):
    ft = feat.feature_table(common.bars(spark, sf_dir), common.calendar())
    out = md.ols_fit(feat.causal_features(ft), LAG_COLS)
    return out.select("symbol", F.round("intercept", 2).alias("intercept"),
                      F.round(F.col("coef")[0], 6).alias("b1"), F.round(F.col("coef")[1], 6).alias("b2"), "n_rows")


def q_gbt_fit_predict(spark, sf_dir):
    """Boosted trees with the service's settings."""
    ft = _features(spark, sf_dir, causal=True)
    cols = feat.feature_columns(ft)
    model = md.gbt_fit(ft.where(F.col("Datetime") < F.lit(TEST_FROM)), cols)
    pred = md.gbt_predict(model, ft.where(F.col("Datetime") >= F.lit(TEST_FROM)))
    return common.round_doubles(pred.select("symbol", "Datetime", "Close", "prediction"), 2)


def q_gbt_stump(spark, sf_dir):
    """One split on the month, all series pooled."""
    ft = common.materialize(feat.feature_table(common.bars(spark, sf_dir), common.calendar())
                            .select("symbol", "Datetime", "month", "Close"))
    model = md.gbt_fit(ft, ["month"], params=STUMP_PARAMS, with_levels=False)
    return common.round_doubles(md.gbt_predict(model, ft).select("symbol", "Datetime", "prediction"), 2)


def q_cross_validate(spark, sf_dir):
    return common.round_doubles(md.cross_validate(_features(spark, sf_dir), "linear",
                                                  common.CV_FOLDS), 2)


def q_cross_validate_causal(spark, sf_dir):
    return common.round_doubles(md.cross_validate(_features(spark, sf_dir, causal=True),
                                                  "linear", common.CV_FOLDS), 2)


def q_cross_validate_lags(spark, sf_dir):
    ft = feat.feature_table(common.bars(spark, sf_dir), common.calendar())
    return common.round_doubles(md.cross_validate(feat.causal_features(ft), "linear", common.CV_FOLDS,
                                                  LAG_COLS), 2)


def q_cross_validate_gbt(spark, sf_dir):
    return common.round_doubles(md.cross_validate(_features(spark, sf_dir, causal=True), "xgboost",
                                                  common.CV_FOLDS, params=md.GBT_SERVICE_PARAMS), 2)


def q_cross_validate_stump(spark, sf_dir):
    """Boosted cross-validation in its one-split form, folds by date, all series pooled."""
    ft = feat.feature_table(common.bars(spark, sf_dir), common.calendar())
    return common.round_doubles(md.cross_validate(
        ft.select("symbol", "Datetime", "month", "Close"), "xgboost", common.CV_FOLDS, ["month"],
        params=STUMP_PARAMS, with_levels=False), 2)


def q_recursive_forecast_gbt(spark, sf_dir):
    ft = _features(spark, sf_dir)
    model = md.gbt_fit(training_frame(ft, common.TRAIN_WINDOW, AS_OF), feat.feature_columns(ft), as_of=AS_OF)
    return recursive_forecast_gbt(model, ft, YEAR, AS_OF, common.calendar(), common.TRAIN_WINDOW)


def q_direct_forecast_gbt(spark, sf_dir):
    return direct_forecast_gbt(_features(spark, sf_dir), HORIZONS, AS_OF, common.calendar(),
                               common.TRAIN_WINDOW, md.GBT_SERVICE_PARAMS)


def q_direct_forecast_stump(spark, sf_dir):
    """The direct boosted form with one split, on the horizon."""
    return common.round_doubles(direct_forecast_gbt(
        _features(spark, sf_dir), HORIZONS, AS_OF, common.calendar(), common.TRAIN_WINDOW, STUMP_PARAMS,
        cols=[], with_levels=False), 2)


QUERIES = {
    "ols_fit_predict": q_ols_fit_predict,
    "ols_fit_predict_causal": q_ols_fit_predict_causal,
    "ols_fit_lags": q_ols_fit_lags,
    "gbt_fit_predict": q_gbt_fit_predict,
    "gbt_stump": q_gbt_stump,
    "cross_validate": q_cross_validate,
    "cross_validate_causal": q_cross_validate_causal,
    "cross_validate_lags": q_cross_validate_lags,
    "cross_validate_gbt": q_cross_validate_gbt,
    "cross_validate_stump": q_cross_validate_stump,
    "recursive_forecast_gbt": q_recursive_forecast_gbt,
    "direct_forecast_gbt": q_direct_forecast_gbt,
    "direct_forecast_stump": q_direct_forecast_stump,
}

K = common.CV_FOLDS

SQL: dict[str, str] = {
    "ols_fit_lags": f"""WITH {lag_rows_cte(window=False)},
{ols2("lagged", "symbol")}
SELECT symbol, {O.r('b0', 2)} AS intercept, {O.r('b1', 6)} AS b1, {O.r('b2', 6)} AS b2,
       CAST(n_rows AS BIGINT) AS n_rows FROM coef""",
    "cross_validate_lags": f"""WITH {lag_rows_cte(window=False)},
folds AS (
  SELECT l.*, f.fold, n // {K + 1} AS ts, n - ({K} - f.fold) * (n // {K + 1}) AS first
  FROM lagged l CROSS JOIN range(0, {K}) f(fold)),
train AS (SELECT * FROM folds WHERE i < first),
{ols2("train", "symbol, fold")},
test AS (
  SELECT t.symbol, t.fold, t."Date", t.y, c.b0 + c.b1 * t.x1 + c.b2 * t.x2 AS p
  FROM folds t JOIN coef c ON t.symbol = c.symbol AND t.fold = c.fold
  WHERE t.i >= t.first AND t.i < t.first + t.ts),
span AS (SELECT symbol, fold, min("Date") AS train_start, max("Date") AS train_end FROM train GROUP BY symbol, fold)
SELECT t.symbol, CAST(t.fold AS INTEGER) AS fold, any_value(train_start) AS train_start,
       any_value(train_end) AS train_end, min(t."Date") AS test_start, max(t."Date") AS test_end,
       {O.r('avg(abs(y - p))', 2)} AS "MAE", {O.r('sqrt(avg((y - p) * (y - p)))', 2)} AS "RMSE",
       {O.r('avg(abs((y - p) / y)) * 100', 2)} AS "MAPE"
FROM test t JOIN span s ON t.symbol = s.symbol AND t.fold = s.fold GROUP BY t.symbol, t.fold""",
    "gbt_stump": f"""WITH {O.BARS_CTE},
rows AS (SELECT symbol, "Date" AS "Datetime", month("Date") AS m, "Close" AS y FROM bars),
cuts AS (
  SELECT c.t, r.m <= c.t AS low, avg(y) AS mean, sum(y * y) - count(*) * avg(y) * avg(y) AS sse
  FROM rows r CROSS JOIN range(1, 12) c(t) GROUP BY c.t, r.m <= c.t),
best AS (SELECT t FROM cuts GROUP BY t ORDER BY sum(sse), t LIMIT 1)
SELECT symbol, "Datetime", {O.r('mean', 2)} AS prediction
FROM rows r, best b JOIN cuts c ON c.t = b.t WHERE c.low = (r.m <= b.t)""",
    "cross_validate_stump": f"""WITH {O.BARS_CTE},
rows AS (SELECT symbol, "Date" AS d, month("Date") AS m, "Close" AS y FROM bars),
days AS (
  SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n, n // {K + 1} AS ts
  FROM (SELECT DISTINCT d FROM rows)),
folds AS (
  SELECT f.fold, (SELECT d FROM days WHERE i = n - ({K} - f.fold) * ts) AS start,
         (SELECT d FROM days WHERE i = n - ({K} - f.fold - 1) * ts) AS until FROM range(0, {K}) f(fold)),
cuts AS (
  SELECT f.fold, c.t, r.m <= c.t AS low, avg(y) AS mean, sum(y * y) - count(*) * avg(y) * avg(y) AS sse
  FROM rows r JOIN folds f ON r.d < f.start CROSS JOIN range(1, 12) c(t) GROUP BY f.fold, c.t, r.m <= c.t),
best AS (
  SELECT fold, t FROM (SELECT fold, t, sum(sse) AS e FROM cuts GROUP BY fold, t)
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY e, t) = 1),
scored AS (
  SELECT r.symbol, f.fold, r.d, r.y, c.mean AS p
  FROM rows r JOIN folds f ON r.d >= f.start AND (f.until IS NULL OR r.d < f.until)
  JOIN best b ON b.fold = f.fold JOIN cuts c ON c.fold = f.fold AND c.t = b.t AND c.low = (r.m <= b.t)),
span AS (
  SELECT r.symbol, f.fold, min(r.d) AS train_start, max(r.d) AS train_end
  FROM rows r JOIN folds f ON r.d < f.start GROUP BY r.symbol, f.fold)
SELECT s.symbol, CAST(s.fold AS INTEGER) AS fold, any_value(train_start) AS train_start,
       any_value(train_end) AS train_end, min(d) AS test_start, max(d) AS test_end,
       {O.r('avg(abs(y - p))', 2)} AS "MAE", {O.r('sqrt(avg((y - p) * (y - p)))', 2)} AS "RMSE",
       {O.r('avg(abs((y - p) / y)) * 100', 2)} AS "MAPE"
FROM scored s JOIN span t ON s.symbol = t.symbol AND s.fold = t.fold GROUP BY s.symbol, s.fold""",
    "direct_forecast_stump": f"""WITH {window_cte(AS_OF)},
pairs AS (
  SELECT t.h, b."Close" AS y FROM tw a CROSS JOIN (SELECT unnest({HORIZONS}) AS h) t
  JOIN tw b ON b.symbol = a.symbol AND b.i = a.i + t.h - 1),
cuts AS (
  SELECT c.t, p.h <= c.t AS low, avg(y) AS mean, sum(y * y) - count(*) * avg(y) * avg(y) AS sse
  FROM pairs p CROSS JOIN (SELECT unnest({HORIZONS[:-1]}) AS t) c GROUP BY c.t, p.h <= c.t),
best AS (SELECT t FROM cuts GROUP BY t ORDER BY sum(sse), t LIMIT 1)
SELECT s.symbol, CAST(h.h AS INTEGER) AS h, CAST({O.date_lit(AS_OF)} + CAST(h.h AS INTEGER) AS DATE) AS target_date,
       {O.r('c.mean', 2)} AS prediction
FROM (SELECT DISTINCT symbol FROM tw) s CROSS JOIN (SELECT unnest({HORIZONS}) AS h) h, best b
JOIN cuts c ON c.t = b.t AND c.low = (h.h <= b.t)""",
}
