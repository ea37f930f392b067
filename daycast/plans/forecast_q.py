"""Registered queries: training window and the forecast operators."""

from __future__ import annotations

import datetime as dt

from daycast.operators import features as feat
from daycast.operators import forecast as fc
from daycast.plans import common
from daycast.plans import oracle as O

H = common.FORECAST_HORIZON
WINDOW = common.TRAIN_WINDOW
AS_OF = common.AS_OF
SCENARIOS = 8
YEAR = 365                     # the service's horizon
MID = dt.date(1998, 1, 1)      # an as-of day in mid-history
REFIT_DAYS, REFIT_WINDOW = 90, 100    # the window drops a row on every day


def _features(spark, sf_dir):
    return feat.feature_table(common.bars(spark, sf_dir), common.calendar())


def q_train_window(spark, sf_dir):
    tw = fc.train_window(common.bars(spark, sf_dir), WINDOW)
    return common.round_doubles(tw.select("symbol", "Date", "Close"))


def q_direct_forecast(spark, sf_dir):
    return common.round_doubles(fc.direct_forecast(common.bars(spark, sf_dir), H, AS_OF, WINDOW), 2)


def q_recursive_forecast_ar(spark, sf_dir):
    return common.round_doubles(
        fc.recursive_forecast_ar(common.bars(spark, sf_dir), H, AS_OF, WINDOW), 2)


def q_train_window_as_of(spark, sf_dir):
    tw = fc.train_window(common.bars(spark, sf_dir), WINDOW, as_of=MID)
    return common.round_doubles(tw.select("symbol", "Date", "Close"))


def q_direct_forecast_as_of(spark, sf_dir):
    return common.round_doubles(fc.direct_forecast(common.bars(spark, sf_dir), H, MID, WINDOW), 2)


def q_recursive_forecast_ar_as_of(spark, sf_dir):
    return common.round_doubles(
        fc.recursive_forecast_ar(common.bars(spark, sf_dir), H, MID, WINDOW), 2)


def q_recursive_forecast_ols(spark, sf_dir):
    """Refitted every day, all causal features, the service's year."""
    return fc.recursive_forecast_ols(_features(spark, sf_dir), YEAR, AS_OF, common.calendar(), WINDOW)


def q_recursive_forecast_ols_once(spark, sf_dir):
    return fc.recursive_forecast_ols(_features(spark, sf_dir), YEAR, AS_OF, common.calendar(), WINDOW,
                                     refit=False)


def q_recursive_forecast_lags(spark, sf_dir):
    out = fc.recursive_forecast_lags(_features(spark, sf_dir), YEAR, MID, common.calendar(), WINDOW)
    return common.round_doubles(out.select("symbol", "h", "target_date", "prediction"), 2)


def q_recursive_refit_lags(spark, sf_dir):
    """Refitted every day on the sliding window, two lags."""
    out = fc.recursive_forecast_lags(_features(spark, sf_dir), REFIT_DAYS, MID, common.calendar(),
                                     REFIT_WINDOW, refit=True)
    return common.round_doubles(out.select("symbol", "h", "target_date", "prediction"), 2)


def q_scenario_forecast(spark, sf_dir):
    return fc.scenario_forecast(_features(spark, sf_dir), YEAR, AS_OF, common.calendar(),
                                scenarios=SCENARIOS, window=WINDOW)


def q_scenario_forecast_calm(spark, sf_dir):
    """Without noise all quantiles are the fit-once path: two lags, for the closed form."""
    out = fc.scenario_forecast(_features(spark, sf_dir), YEAR, MID, common.calendar(), SCENARIOS, WINDOW,
                               noise_scale=0.0, cols=fc.LAG_COLS, clip=False)
    return common.round_doubles(out, 2)


def q_direct_forecast_year(spark, sf_dir):
    """All horizons of a year."""
    return common.round_doubles(fc.direct_forecast(common.bars(spark, sf_dir), YEAR, AS_OF, WINDOW), 2)


QUERIES = {
    "train_window": q_train_window,
    "direct_forecast": q_direct_forecast,
    "recursive_forecast_ar": q_recursive_forecast_ar,
    "train_window_as_of": q_train_window_as_of,
    "direct_forecast_as_of": q_direct_forecast_as_of,
    "recursive_forecast_ar_as_of": q_recursive_forecast_ar_as_of,
    "recursive_forecast_ols": q_recursive_forecast_ols,
    "recursive_forecast_ols_once": q_recursive_forecast_ols_once,
    "recursive_forecast_lags": q_recursive_forecast_lags,
    "recursive_refit_lags": q_recursive_refit_lags,
    "scenario_forecast": q_scenario_forecast,
    "scenario_forecast_calm": q_scenario_forecast_calm,
    "direct_forecast_year": q_direct_forecast_year,
}


def window_cte(as_of) -> str:
    return f"""{O.BARS_CTE},
tw AS (
  SELECT symbol, "Date", "Close",
         row_number() OVER (PARTITION BY symbol ORDER BY "Date") AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "Date" DESC) AS r FROM bars
        WHERE "Date" <= {O.date_lit(as_of)})
  WHERE r <= {WINDOW})"""


def lag_rows_cte(as_of=None, window: bool = True) -> str:
    """lagged(symbol, "Date", i, n, x1, x2, y): Close and its lags 1 and 3, missing lags 0."""
    until = f'WHERE "Date" <= {O.date_lit(as_of)}' if as_of else ""
    last = f"WHERE i > n - {WINDOW}" if window else ""
    return f"""{O.BARS_CTE},
lagged AS (
  SELECT symbol, "Date", i - 1 AS i, n, x1, x2, y FROM (
    SELECT symbol, "Date", "Close" AS y,
           coalesce(lag("Close", 1) OVER (PARTITION BY symbol ORDER BY "Date"), 0) AS x1,
           coalesce(lag("Close", 3) OVER (PARTITION BY symbol ORDER BY "Date"), 0) AS x2,
           row_number() OVER (PARTITION BY symbol ORDER BY "Date") AS i,
           count(*) OVER (PARTITION BY symbol) AS n
    FROM bars {until}) {last})"""


def ols2(rows: str, keys: str) -> str:
    """means, sums, coef: closed-form least squares of y on x1, x2 per key."""
    same = " AND ".join(f"r.{k} = m.{k}" for k in keys.split(", "))
    out = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""means AS (
  SELECT {keys}, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) AS n_rows FROM {rows} GROUP BY {keys}),
sums AS (
  SELECT {out}, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, any_value(n_rows) AS n_rows,
         sum((x1 - m1) * (x1 - m1)) AS s11, sum((x2 - m2) * (x2 - m2)) AS s22,
         sum((x1 - m1) * (x2 - m2)) AS s12, sum((x1 - m1) * (y - my)) AS s1y,
         sum((x2 - m2) * (y - my)) AS s2y
  FROM {rows} r JOIN means m ON {same} GROUP BY {out}),
slopes AS (
  SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
         (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM sums),
coef AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM slopes)"""


def _sql(as_of) -> dict[str, str]:
    cte, day = window_cte(as_of), O.date_lit(as_of)
    return {
    "train_window": f"""WITH {cte}
SELECT symbol, "Date", {O.r('"Close"')} AS "Close" FROM tw""",
    "direct_forecast": f"""WITH {cte},
pairs AS (
  SELECT a.symbol, t.h, a."Date", a."Close" AS x, b."Close" AS y
  FROM tw a CROSS JOIN range(1, {H + 1}) t(h)
  LEFT JOIN tw b ON b.symbol = a.symbol AND b.i = a.i + t.h),
fit AS (
  SELECT symbol, h, regr_intercept(y, x) AS a, regr_slope(y, x) AS b,
         arg_max(x, "Date") AS x_last
  FROM pairs GROUP BY symbol, h)
SELECT symbol, CAST(h AS INTEGER) AS h, CAST({day} + CAST(h AS INTEGER) AS DATE) AS target_date,
       {O.r('a + b * x_last', 2)} AS prediction FROM fit""",
    "recursive_forecast_ar": f"""WITH RECURSIVE {cte},
lagged AS (
  SELECT symbol, "Date", "Close" AS y,
         lag("Close") OVER (PARTITION BY symbol ORDER BY "Date") AS x FROM tw),
coef AS (
  SELECT symbol, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1,
         arg_max(y, "Date") AS y0 FROM lagged GROUP BY symbol),
path(symbol, h, v) AS (
  SELECT symbol, 0, y0 FROM coef
  UNION ALL
  SELECT p.symbol, p.h + 1, c.b0 + c.b1 * p.v FROM path p JOIN coef c ON p.symbol = c.symbol
  WHERE p.h < {H})
SELECT symbol, CAST(h AS INTEGER) AS h, CAST({day} + CAST(h AS INTEGER) AS DATE) AS target_date,
       {O.r('v', 2)} AS prediction FROM path WHERE h >= 1""",
    }


SQL = _sql(AS_OF) | {f"{k}_as_of": v for k, v in _sql(MID).items()} | {
    "recursive_forecast_lags": f"""WITH RECURSIVE {lag_rows_cte(MID)},
{ols2("lagged", "symbol")},
last AS (
  SELECT symbol, max(CASE WHEN k = 1 THEN y END) AS c1, max(CASE WHEN k = 2 THEN y END) AS c2,
         max(CASE WHEN k = 3 THEN y END) AS c3
  FROM (SELECT symbol, y, row_number() OVER (PARTITION BY symbol ORDER BY "Date" DESC) AS k FROM lagged)
  WHERE k <= 3 GROUP BY symbol),
path(symbol, h, c1, c2, c3) AS (
  SELECT symbol, 0, c1, c2, c3 FROM last
  UNION ALL
  SELECT p.symbol, p.h + 1, c.b0 + c.b1 * p.c1 + c.b2 * p.c3, p.c1, p.c2
  FROM path p JOIN coef c ON p.symbol = c.symbol WHERE p.h < {YEAR})
SELECT symbol, CAST(h AS INTEGER) AS h, CAST({O.date_lit(MID)} + CAST(h AS INTEGER) AS DATE) AS target_date,
       {O.r('c1', 2)} AS prediction FROM path WHERE h >= 1""",
    # sums over the window, about the series' mean c, carried from day to day: the
    # oldest row goes, the predicted one comes
    "recursive_refit_lags": f"""WITH RECURSIVE {lag_rows_cte(MID, window=False)},
base AS (
  SELECT symbol, i - (n - {REFIT_WINDOW}) AS k, x1 - c AS u, x2 - c AS v, y - c AS w, c
  FROM (SELECT *, avg(y) OVER (PARTITION BY symbol) AS c FROM lagged) WHERE i >= n - {REFIT_WINDOW}),
last AS (
  SELECT symbol, max(CASE WHEN k = {REFIT_WINDOW - 1} THEN w END) AS c1,
         max(CASE WHEN k = {REFIT_WINDOW - 2} THEN w END) AS c2,
         max(CASE WHEN k = {REFIT_WINDOW - 3} THEN w END) AS c3 FROM base GROUP BY symbol),
path(symbol, h, c, c1, c2, c3, su, sv, sw, uu, vv, uv, uw, vw) AS (
  SELECT b.symbol, 0, any_value(c), any_value(c1), any_value(c2), any_value(c3), sum(u), sum(v), sum(w),
         sum(u * u), sum(v * v), sum(u * v), sum(u * w), sum(v * w)
  FROM base b JOIN last l ON l.symbol = b.symbol GROUP BY b.symbol
  UNION ALL
  SELECT symbol, h + 1, c, p, c1, c2, su + c1 - o.u, sv + c3 - o.v, sw + p - o.w, uu + c1 * c1 - o.u * o.u,
         vv + c3 * c3 - o.v * o.v, uv + c1 * c3 - o.u * o.v, uw + c1 * p - o.u * o.w, vw + c3 * p - o.v * o.w
  FROM (
    SELECT *, sw / {REFIT_WINDOW} + b1 * (c1 - su / {REFIT_WINDOW}) + b2 * (c3 - sv / {REFIT_WINDOW}) AS p FROM (
      SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
             (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM (
        SELECT *, uu - su * su / {REFIT_WINDOW} AS s11, vv - sv * sv / {REFIT_WINDOW} AS s22,
               uv - su * sv / {REFIT_WINDOW} AS s12, uw - su * sw / {REFIT_WINDOW} AS s1y,
               vw - sv * sw / {REFIT_WINDOW} AS s2y FROM path WHERE h < {REFIT_DAYS}))) q
  JOIN (SELECT symbol AS s, k, u, v, w FROM base) o ON o.s = q.symbol AND o.k = q.h)
SELECT symbol, CAST(h AS INTEGER) AS h, CAST({O.date_lit(MID)} + CAST(h AS INTEGER) AS DATE) AS target_date,
       {O.r('c1 + c', 2)} AS prediction FROM path WHERE h >= 1""",
}
SQL["direct_forecast_year"] = SQL["direct_forecast"].replace(f"range(1, {H + 1})", f"range(1, {YEAR + 1})")
SQL["scenario_forecast_calm"] = f"""SELECT symbol, h, target_date, prediction AS p10, prediction AS p50,
       prediction AS p90, CAST({SCENARIOS} AS BIGINT) AS paths FROM ({SQL["recursive_forecast_lags"]})"""
