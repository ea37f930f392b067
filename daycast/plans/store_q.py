"""Registered queries: folds, CV, scoring, the forecast store and reports.

The store is fed by a forecast log that Spark derives from the bars, so
its size grows with the data: at the first day of every month each series
gets two runs — ``naive`` (last Close of the previous month) and ``ma7``
(last 7-day mean Close) — each forecasting the next FORECAST_HORIZON days.
Consecutive runs overlap, so the newest-run-wins rule is exercised on
every month boundary.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daycast.functions.windows import rolling_mean, series_window
from daycast.operators import evaluation as ev
from daycast.operators import folds as fo
from daycast.operators import store as st
from daycast.plans import common
from daycast.plans import oracle as O
from daycast.sources.ticks import table

H = common.FORECAST_HORIZON
AS_OF = common.AS_OF
REPORT_HORIZON = 7     # rows of the forecast table per series
RERUN_MONTHS = 3       # runs re-uploaded with force in replace_run
RERUN_HORIZON = 45


def forecast_log(bars: DataFrame, horizon: int = H) -> DataFrame:
    """(symbol, model, run_date, target_date, prediction) derived from bars."""
    b = bars.select("symbol", "Date", "Close",
                    rolling_mean("Close", 7, series_window()).alias("ma7"))
    monthly = b.groupBy("symbol", F.trunc("Date", "month").alias("m")).agg(
        F.max_by("Close", "Date").alias("naive"), F.max_by("ma7", "Date").alias("ma7"))
    runs = monthly.select(
        "symbol", F.add_months("m", 1).alias("run_date"),
        F.explode(F.array(
            F.struct(F.lit("naive").alias("model"), F.col("naive").alias("prediction")),
            F.struct(F.lit("ma7").alias("model"), F.col("ma7").alias("prediction")))).alias("r"))
    return (runs.where(F.col("r.prediction").isNotNull())
                .select("symbol", "r.model", "run_date", "r.prediction",
                        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
                .select("symbol", "model", "run_date",
                        F.date_add("run_date", F.col("h")).alias("target_date"),
                        "prediction"))


def _log(spark, sf_dir) -> DataFrame:
    return forecast_log(common.bars(spark, sf_dir))


def _shared_log(spark, sf_dir) -> DataFrame:
    """The log tagged with each series' last run, computed once: the store
    queries read it in two branches (older runs vs the newest run)."""
    return common.materialize(_last_run(_log(spark, sf_dir)))


def _last_run(log: DataFrame) -> DataFrame:
    """Tag each row with the last run_date of its series (an aggregate joined back:
    the log of a series is not bounded by its days)."""
    last = log.groupBy("symbol", "model").agg(F.max("run_date").alias("last_run"))
    return log.join(last, ["symbol", "model"])


def _cur_cols(df: DataFrame) -> DataFrame:
    return df.select("symbol", "model", "target_date", "prediction", "run_date")


# --- step 5 ---------------------------------------------------------------------

def q_expanding_folds(spark, sf_dir):
    f = fo.expanding_folds(common.bars(spark, sf_dir), common.CV_FOLDS)
    return f.select("symbol", "Date", "i", "n", F.col("fold").cast("int").alias("fold"), "role")


def q_cv_trend_ols(spark, sf_dir):
    cv = fo.cv_trend_ols(common.bars(spark, sf_dir), common.CV_FOLDS)
    return common.round_doubles(cv.withColumn("fold", F.col("fold").cast("int")), 2)


def _fva(spark, sf_dir):
    b = common.shared_bars(spark, sf_dir)
    return ev.forecast_vs_actual(st.latest_per_target(forecast_log(b)), b)


def q_forecast_vs_actual(spark, sf_dir):
    return common.round_doubles(_fva(spark, sf_dir))


def q_day_metrics(spark, sf_dir):
    return common.round_doubles(ev.day_metrics(_fva(spark, sf_dir)))


# Report averages are means of 2-decimal prices: at 6 places an exact
# decimal tie (where half-up and binary rounding disagree) would need 2^6 or
# 5^5 to divide the day count, which a month never does.
REPORT_DIGITS = 6


def q_model_report(spark, sf_dir):
    return common.round_doubles(ev.model_report(_fva(spark, sf_dir)), REPORT_DIGITS)


def q_model_report_monthly(spark, sf_dir):
    return common.round_doubles(ev.model_report(_fva(spark, sf_dir), ["month"]), REPORT_DIGITS)


# --- step 6 ---------------------------------------------------------------------

def q_latest_per_target(spark, sf_dir):
    return common.round_doubles(_cur_cols(st.latest_per_target(_log(spark, sf_dir))))


def q_merge_current(spark, sf_dir):
    log = _shared_log(spark, sf_dir)
    current = _cur_cols(st.latest_per_target(log.where(F.col("run_date") < F.col("last_run"))))
    incoming = log.where(F.col("run_date") == F.col("last_run")).drop("last_run")
    return common.round_doubles(st.merge_current(current, incoming))


def _index_cols(df):
    return df.select("symbol", "model", "run_date", "horizon", "rows_count")


def q_list_runs(spark, sf_dir):
    return _index_cols(st.run_rows(_log(spark, sf_dir), H, {"source": "bars"}))


def q_upsert_run(spark, sf_dir):
    log = _shared_log(spark, sf_dir)
    old = st.run_rows(log.where(F.col("run_date") < F.col("last_run")), H)
    new = st.run_rows(log.where(F.col("run_date") == F.col("last_run")), H)
    return _index_cols(st.upsert_run(old, new))


def q_replace_run(spark, sf_dir):
    log = _shared_log(spark, sf_dir)
    index = st.run_rows(log, H)
    recent = log.where(F.col("run_date") > F.add_months("last_run", -RERUN_MONTHS))
    rerun = st.run_rows(recent, RERUN_HORIZON, {"rerun": "true"})
    return _index_cols(st.replace_run(index, rerun))


def q_get_current(spark, sf_dir):
    return common.round_doubles(st.get_current(_cur_cols(st.latest_per_target(_log(spark, sf_dir))),
                                               "naive"))


def q_is_stale(spark, sf_dir):
    return st.is_stale(common.bars(spark, sf_dir), AS_OF)


def q_needs_forecast(spark, sf_dir):
    log = common.materialize(_log(spark, sf_dir))
    return st.needs_forecast(log, st.latest_per_target(log), AS_OF)


def q_is_stale_series(spark, sf_dir):
    """Freshness of a list of series, some without any bar (order classes and line flags)."""
    b = common.bars(spark, sf_dir)
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol")).distinct()
    classes = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct()
    return st.is_stale(b, AS_OF, series=classes.unionByName(flags))


def q_needs_forecast_models(spark, sf_dir):
    """Every series with every known model, one of which has never run."""
    log = common.materialize(_log(spark, sf_dir))
    series = log.select("symbol").distinct().select("symbol", F.explode(F.array(
        *[F.lit(m) for m in (*common.STORE_MODELS, "drift")])).alias("model"))
    return st.needs_forecast(series, st.latest_per_target(log), AS_OF)


def q_runs_as_text(spark, sf_dir):
    """The run index as text: days, counts, and the merged settings as JSON."""
    runs = st.run_rows(_log(spark, sf_dir), H, {"source": "bars", "horizon": "7"})
    over = F.create_map(F.lit("horizon"), st.number_text(F.col("horizon")))
    return runs.select("symbol", "model", st.day_text(F.col("run_date")).alias("run_day"),
                       st.number_text(F.col("rows_count")).alias("rows_text"),
                       st.number_text(F.col("rows_count") / 7, 2).alias("weeks"),
                       st.params_json(st.merge_params(F.col("params"), over)).alias("params"))


# --- step 10: reports -------------------------------------------------------------

def q_forecast_table(spark, sf_dir):
    cur = st.latest_per_target(_log(spark, sf_dir)).where(F.col("target_date") > F.lit(AS_OF))
    return st.forecast_table(cur, REPORT_HORIZON)


def q_compare_models(spark, sf_dir):
    return common.round_doubles(ev.compare_models(st.latest_per_target(_log(spark, sf_dir)),
                                                  list(common.STORE_MODELS)))


def q_overlay_history_forecast(spark, sf_dir):
    b = common.shared_bars(spark, sf_dir)
    return common.round_doubles(ev.overlay_history_forecast(b, st.latest_per_target(forecast_log(b))))


QUERIES = {
    "expanding_folds": q_expanding_folds,
    "cv_trend_ols": q_cv_trend_ols,
    "forecast_vs_actual": q_forecast_vs_actual,
    "day_metrics": q_day_metrics,
    "model_report": q_model_report,
    "model_report_monthly": q_model_report_monthly,
    "latest_per_target": q_latest_per_target,
    "merge_current": q_merge_current,
    "list_runs": q_list_runs,
    "upsert_run": q_upsert_run,
    "replace_run": q_replace_run,
    "get_current": q_get_current,
    "is_stale": q_is_stale,
    "needs_forecast": q_needs_forecast,
    "is_stale_series": q_is_stale_series,
    "needs_forecast_models": q_needs_forecast_models,
    "runs_as_text": q_runs_as_text,
    "forecast_table": q_forecast_table,
    "compare_models": q_compare_models,
    "overlay_history_forecast": q_overlay_history_forecast,
}


# --- oracle SQL -----------------------------------------------------------------------

def _d(d: dt.date) -> str:
    return O.date_lit(d)


FOLDS_CTE = f"""{O.BARS_CTE},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "Date") - 1 AS i,
         count(*) OVER (PARTITION BY symbol) AS n FROM bars),
folds AS (
  SELECT b.*, f.fold,
         CASE WHEN i < n - ({common.CV_FOLDS} - f.fold) * (n // {common.CV_FOLDS + 1}) THEN 'train'
              WHEN i < n - ({common.CV_FOLDS} - f.fold) * (n // {common.CV_FOLDS + 1})
                       + (n // {common.CV_FOLDS + 1}) THEN 'test' END AS role
  FROM numbered b CROSS JOIN range(0, {common.CV_FOLDS}) f(fold)
  WHERE n // {common.CV_FOLDS + 1} > 0)"""

LOG_CTE = f"""{O.BARS_CTE},
ma AS (
  SELECT symbol, "Date", "Close",
         {O.mean_sql("Close", 7)} AS ma7 FROM bars),
monthly AS (
  SELECT symbol, CAST(date_trunc('month', "Date") + INTERVAL 1 MONTH AS DATE) AS run_date,
         arg_max("Close", "Date") AS naive, arg_max(ma7, "Date") AS ma7
  FROM ma GROUP BY symbol, date_trunc('month', "Date")),
runs AS (
  SELECT symbol, 'naive' AS model, run_date, naive AS prediction FROM monthly
  UNION ALL
  SELECT symbol, 'ma7' AS model, run_date, ma7 AS prediction FROM monthly),
log AS (
  SELECT symbol, model, run_date, CAST(run_date + CAST(h AS INTEGER) AS DATE) AS target_date,
         prediction
  FROM runs CROSS JOIN range(1, {H + 1}) t(h) WHERE prediction IS NOT NULL),
lastrun AS (
  SELECT *, max(run_date) OVER (PARTITION BY symbol, model) AS last_run FROM log),
cur AS (
  SELECT symbol, model, target_date, arg_max(prediction, run_date) AS prediction,
         max(run_date) AS run_date
  FROM log GROUP BY symbol, model, target_date)"""

FVA_CTE = f"""{LOG_CTE},
fva AS (
  SELECT c.symbol, c.model, c.target_date, c.run_date, b."Close" AS actual,
         c.prediction AS predicted
  FROM cur c JOIN bars b ON c.symbol = b.symbol AND c.target_date = b."Date")"""


def _index_sql(where: str, horizon: int) -> str:
    return (f"SELECT symbol, model, run_date, CAST({horizon} AS INTEGER) AS horizon, "
            f"count(*) AS rows_count FROM lastrun WHERE {where} GROUP BY symbol, model, run_date")


SQL = {
    "expanding_folds": f"""WITH {FOLDS_CTE}
SELECT symbol, "Date", i, n, CAST(fold AS INTEGER) AS fold, role FROM folds WHERE role IS NOT NULL""",
    "cv_trend_ols": f"""WITH {FOLDS_CTE},
coef AS (
  SELECT symbol, fold,
         regr_slope(CASE WHEN role = 'train' THEN "Close" END,
                    CASE WHEN role = 'train' THEN CAST(i AS DOUBLE) END) AS b,
         regr_intercept(CASE WHEN role = 'train' THEN "Close" END,
                        CASE WHEN role = 'train' THEN CAST(i AS DOUBLE) END) AS a
  FROM folds WHERE role IS NOT NULL GROUP BY symbol, fold),
scored AS (
  SELECT f.symbol, f.fold, f.role, f."Date", f."Close" AS y, c.a + c.b * CAST(f.i AS DOUBLE) AS p
  FROM folds f JOIN coef c USING (symbol, fold) WHERE f.role IS NOT NULL)
SELECT symbol, CAST(fold AS INTEGER) AS fold,
  min(CASE WHEN role = 'train' THEN "Date" END) AS train_start,
  max(CASE WHEN role = 'train' THEN "Date" END) AS train_end,
  min(CASE WHEN role = 'test' THEN "Date" END) AS test_start,
  max(CASE WHEN role = 'test' THEN "Date" END) AS test_end,
  {O.r("avg(CASE WHEN role = 'test' THEN abs(y - p) END)", 2)} AS "MAE",
  {O.r("sqrt(avg(CASE WHEN role = 'test' THEN (y - p) * (y - p) END))", 2)} AS "RMSE",
  {O.r("CASE WHEN bool_and(CASE WHEN role = 'test' THEN y <> 0 END) THEN "
       "avg(CASE WHEN role = 'test' THEN abs((y - p) / y) END) * 100 END", 2)} AS "MAPE"
FROM scored GROUP BY symbol, fold""",
    "forecast_vs_actual": f"""WITH {FVA_CTE}
SELECT symbol, model, target_date, run_date, {O.r('actual')} AS actual,
       {O.r('predicted')} AS predicted FROM fva""",
    "day_metrics": f"""WITH {FVA_CTE}
SELECT symbol, model, target_date AS date, {O.r('actual')} AS actual,
       {O.r('predicted')} AS predicted, {O.r('abs(actual - predicted)')} AS "MAE",
       {O.r('sqrt((actual - predicted) * (actual - predicted))')} AS "RMSE",
       {O.r('CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) * 100 END')} AS "MAPE"
FROM fva""",
    "model_report": f"""WITH {FVA_CTE}
SELECT symbol, model, {O.r('avg(abs(actual - predicted))', REPORT_DIGITS)} AS "MAE",
       {O.r('sqrt(avg((actual - predicted) * (actual - predicted)))', REPORT_DIGITS)} AS "RMSE",
       {O.r('CASE WHEN bool_and(actual <> 0) THEN avg(abs((actual - predicted) / actual)) * 100 END', REPORT_DIGITS)} AS "MAPE",
       count(*) AS days
FROM fva GROUP BY symbol, model""",
    "model_report_monthly": f"""WITH {FVA_CTE}
SELECT symbol, model, CAST(date_trunc('month', target_date) AS DATE) AS month,
       {O.r('avg(abs(actual - predicted))', REPORT_DIGITS)} AS "MAE",
       {O.r('sqrt(avg((actual - predicted) * (actual - predicted)))', REPORT_DIGITS)} AS "RMSE",
       {O.r('CASE WHEN bool_and(actual <> 0) THEN avg(abs((actual - predicted) / actual)) * 100 END', REPORT_DIGITS)} AS "MAPE",
       count(*) AS days
FROM fva GROUP BY symbol, model, date_trunc('month', target_date)""",
    "latest_per_target": f"""WITH {LOG_CTE}
SELECT symbol, model, target_date, {O.r('prediction')} AS prediction, run_date FROM cur""",
    "merge_current": f"""WITH {LOG_CTE},
old_cur AS (
  SELECT symbol, model, target_date, arg_max(prediction, run_date) AS prediction,
         max(run_date) AS run_date
  FROM lastrun WHERE run_date < last_run GROUP BY symbol, model, target_date),
inc AS (SELECT symbol, model, target_date, prediction, run_date FROM lastrun
        WHERE run_date = last_run AND target_date > run_date),
both_ AS (SELECT *, 0 AS src FROM old_cur UNION ALL SELECT *, 1 AS src FROM inc),
ranked AS (
  SELECT *, max(CASE WHEN src = 1 THEN run_date END) OVER (PARTITION BY symbol, model) AS inc_run,
         row_number() OVER (PARTITION BY symbol, model, target_date
                            ORDER BY run_date DESC, src DESC) AS rk
  FROM both_)
SELECT symbol, model, target_date, {O.r('prediction')} AS prediction, run_date FROM ranked
WHERE inc_run IS NULL OR target_date < inc_run OR rk = 1""",
    "list_runs": f"WITH {LOG_CTE}\n" + _index_sql("true", H),
    "upsert_run": f"WITH {LOG_CTE}\n" + _index_sql("run_date < last_run", H) +
                  "\nUNION ALL\n" + _index_sql("run_date = last_run", H),
    "replace_run": f"""WITH {LOG_CTE},
idx AS ({_index_sql("true", H)}),
rerun AS ({_index_sql(f"run_date > CAST(last_run - INTERVAL {RERUN_MONTHS} MONTH AS DATE)",
                      RERUN_HORIZON)})
SELECT * FROM idx WHERE NOT EXISTS (
  SELECT 1 FROM rerun r WHERE r.symbol = idx.symbol AND r.model = idx.model
                          AND r.run_date = idx.run_date)
UNION ALL SELECT * FROM rerun""",
    "get_current": f"""WITH {LOG_CTE}
SELECT symbol, model, target_date, {O.r('prediction')} AS prediction, run_date FROM cur
WHERE model = 'naive'""",
    "is_stale": f"""WITH {O.BARS_CTE}
SELECT symbol, max("Date") AS last_date,
       coalesce(max("Date") <> CAST({_d(AS_OF)} - INTERVAL 1 DAY AS DATE), true) AS stale
FROM bars GROUP BY symbol""",
    "needs_forecast": f"""WITH {LOG_CTE},
series AS (SELECT DISTINCT symbol, model FROM log),
tom AS (SELECT symbol, model, run_date AS tomorrow_run FROM cur
        WHERE target_date = CAST({_d(AS_OF)} + INTERVAL 1 DAY AS DATE))
SELECT s.symbol, s.model, t.tomorrow_run,
       coalesce(t.tomorrow_run <> {_d(AS_OF)}, true) AS needs_forecast
FROM series s LEFT JOIN tom t ON s.symbol = t.symbol AND s.model = t.model""",
    "is_stale_series": f"""WITH {O.BARS_CTE},
series AS (SELECT DISTINCT o_orderpriority AS symbol FROM orders UNION SELECT DISTINCT l_returnflag FROM lineitem)
SELECT s.symbol, max("Date") AS last_date,
       coalesce(max("Date") <> CAST({_d(AS_OF)} - INTERVAL 1 DAY AS DATE), true) AS stale
FROM series s LEFT JOIN bars b ON s.symbol = b.symbol GROUP BY s.symbol""",
    "needs_forecast_models": f"""WITH {LOG_CTE},
series AS (SELECT DISTINCT symbol, m.model FROM log CROSS JOIN (VALUES ('naive'), ('ma7'), ('drift')) m(model)),
tom AS (SELECT symbol, model, run_date AS tomorrow_run FROM cur
        WHERE target_date = CAST({_d(AS_OF)} + INTERVAL 1 DAY AS DATE))
SELECT s.symbol, s.model, t.tomorrow_run,
       coalesce(t.tomorrow_run <> {_d(AS_OF)}, true) AS needs_forecast
FROM series s LEFT JOIN tom t ON s.symbol = t.symbol AND s.model = t.model""",
    "runs_as_text": f"""WITH {LOG_CTE}
SELECT symbol, model, strftime(run_date, '%Y-%m-%d') AS run_day, CAST(count(*) AS VARCHAR) AS rows_text,
       printf('%.2f', count(*) / 7.0) AS weeks,
       concat('{{"horizon":"', {H}, '","source":"bars"}}') AS params
FROM log GROUP BY symbol, model, run_date""",
    "forecast_table": f"""WITH {LOG_CTE},
fut AS (SELECT *, row_number() OVER (PARTITION BY symbol, model ORDER BY target_date) AS rn
        FROM cur WHERE target_date > {_d(AS_OF)})
SELECT symbol, model, target_date AS "Date", {O.r('prediction', 2)} AS "Predicted Price"
FROM fut WHERE rn <= {REPORT_HORIZON}""",
    "compare_models": f"""WITH {LOG_CTE}
SELECT symbol, target_date,
       {O.r("max(CASE WHEN model = 'naive' THEN prediction END)")} AS naive,
       {O.r("max(CASE WHEN model = 'ma7' THEN prediction END)")} AS ma7
FROM cur GROUP BY symbol, target_date""",
    "overlay_history_forecast": f"""WITH {LOG_CTE}
SELECT symbol, "Date" AS date, {O.r('"Close"')} AS value, 'actual' AS series FROM bars
UNION ALL
SELECT symbol, target_date AS date, {O.r('prediction')} AS value, model AS series FROM cur""",
}
