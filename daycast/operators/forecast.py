"""Forecast operators. Every one reads rows up to ``as_of`` only.

* ``direct_forecast`` — one ``Close[t+h] ~ Close[t]`` fit per (symbol, h), all from
  running sums and one array per series: no pairs of rows, no copy per horizon.
* ``recursive_forecast_ar`` — AR(1) fit once per series, then H steps inside one
  ``aggregate`` expression.
* ``recursive_forecast_ols`` — a model of all features. Fitted once, it is rolled
  forward from one row per series (``rollout.py``); with ``refit`` it is fitted anew every day from a
  sliding window of mergeable factors.
* ``recursive_forecast_lags`` — either recursion on two lags of Close.
* ``scenario_forecast`` — seeded noise paths of the fit-once model, quantiles per day.

The causal feature set is the default: the as-is set holds the day's own candle
body, from which Close follows by addition, so a fit on it is exact and its
recursion only carries the last bar.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daycast.operators import factors as fa
from daycast.operators import features as feat
from daycast.operators import recursion as rec
from daycast.operators import rollout
from daycast.operators.windowing import train_window
from daycast.session import stored

__all__ = ["train_window", "direct_forecast", "ar_coefficients", "ar_path", "recursive_forecast_ar",
           "recursive_forecast_ols", "recursive_forecast_lags", "scenario_forecast"]


def direct_forecast(bars: DataFrame, horizon: int, as_of: dt.date, window: int = 1095,
                    target: str = "Close", order: str = "Date") -> DataFrame:
    """Per (symbol, h): ``target[t+h] = a_h + b_h * target[t]`` fitted on the
    training window, applied to the last value. Output one row per
    (symbol, h) with ``target_date = as_of + h``."""
    tw = train_window(bars.select("symbol", order, F.col(target).cast("double").alias("_v")), window, order,
                      as_of=as_of)
    every = Window.partitionBy("symbol")
    running = every.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # u: distance to the series' mean (0 where the value is missing), with running sums
    rows = (tw.withColumn("_c", F.avg("_v").over(every))
            .withColumn("_u", F.coalesce(F.col("_v") - F.col("_c"), F.lit(0.0)))
            .withColumns({"_su": F.sum("_u").over(running), "_sq": F.sum(F.col("_u") * F.col("_u")).over(running)}))
    series = rows.groupBy("symbol").agg(
        F.first("_c").alias("c"), F.count(F.lit(1)).cast("int").alias("n"),
        (F.count("_v") < F.count(F.lit(1))).alias("gaps"),
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("d"), "_v", "_u", "_su", "_sq"))).alias("r")) \
        .select("symbol", "c", "n", "gaps", F.expr("element_at(r, -1)._v").alias("v_last"),
                *[F.expr(f"transform(r, e -> e.{x})").alias(y) for x, y in
                  (("_v", "v"), ("_u", "u"), ("_su", "su"), ("_sq", "sq"))])
    # sums over the pairs (t, t + h): means and variances are differences of running sums,
    # only the lagged product is a pass over the array. With missing values all are.
    lagged = "aggregate(u, named_struct('t', 0, 's', 0D), (a, x) -> named_struct('t', a.t + 1, 's', " \
        "a.s + x * coalesce(get(u, a.t + h), 0D))).s"
    whole = ("named_struct('h', h, 'm', CAST(n - h AS DOUBLE), 'sx', get(su, n - h - 1), "
             "'sy', get(su, n - 1) - get(su, h - 1), 'sxx', get(sq, n - h - 1), 'sxy', " + lagged + ")")
    zero = "named_struct('t', 0, 'm', 0D, 'sx', 0D, 'sy', 0D, 'sxx', 0D, 'sxy', 0D)"
    add = ("named_struct('t', a.t + 1, 'm', a.m + 1, 'sx', a.sx + get(u, a.t), 'sy', a.sy + get(u, a.t + h), "
           "'sxx', a.sxx + get(u, a.t) * get(u, a.t), 'sxy', a.sxy + get(u, a.t) * get(u, a.t + h))")
    skip = "named_struct('t', a.t + 1, 'm', a.m, 'sx', a.sx, 'sy', a.sy, 'sxx', a.sxx, 'sxy', a.sxy)"
    pairs = (f"aggregate(v, {zero}, (a, x) -> IF(x IS NOT NULL AND get(v, a.t + h) IS NOT NULL, {add}, {skip}), "
             "a -> named_struct('h', h, 'm', a.m, 'sx', a.sx, 'sy', a.sy, 'sxx', a.sxx, 'sxy', a.sxy))")
    each = series.select("symbol", "c", "v_last", F.inline(F.expr(
        f"transform(sequence(1, {int(horizon)}), h -> IF(h < n, IF(gaps, {pairs}, {whole}), "
        "named_struct('h', h, 'm', 0D, 'sx', 0D, 'sy', 0D, 'sxx', 0D, 'sxy', 0D)))")))
    var, slope = "sxx - sx * sx / nullif(m, 0D)", "sxy - sx * sy / nullif(m, 0D)"
    # a variance that is rounding error is none
    b = f"IF({var} > 1e-12D * sxx, ({slope}) / nullif({var}, 0D), NULL)"
    return each.select("symbol", F.col("h").cast("int").alias("h"),
                       F.date_add(F.lit(as_of), F.col("h")).alias("target_date"),
                       F.expr(f"c + sy / nullif(m, 0D) + {b} * (v_last - c - sx / nullif(m, 0D))").alias("prediction"))


def ar_coefficients(bars: DataFrame, window: int = 1095, target: str = "Close",
                    order: str = "Date", as_of: dt.date | None = None) -> DataFrame:
    """AR(1) per series on the training window: intercept, slope, last value."""
    tw = train_window(bars.select("symbol", order, target), window, order, as_of=as_of)
    w = Window.partitionBy("symbol").orderBy(order)
    lagged = tw.withColumn("x", F.lag(target, 1).over(w))
    return lagged.groupBy("symbol").agg(
        F.regr_intercept(target, "x").alias("b0"), F.regr_slope(target, "x").alias("b1"),
        F.max_by(target, order).alias("y0"))


def ar_path(b0: Column, b1: Column, y0: Column, horizon: int) -> Column:
    """[y1..yH] with y_t = b0 + b1 * y_{t-1}, folded in one HOF."""
    start = F.array(y0.cast("double"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start,
                       lambda acc, i: F.concat(acc, F.array(b0 + b1 * F.element_at(acc, -1))))
    return F.slice(path, 2, horizon)


def recursive_forecast_ar(bars: DataFrame, horizon: int, as_of: dt.date,
                          window: int = 1095) -> DataFrame:
    coef = ar_coefficients(bars, window, as_of=as_of)
    return (coef.select("symbol", F.posexplode(ar_path(F.col("b0"), F.col("b1"), F.col("y0"),
                                                       horizon)).alias("pos", "prediction"))
                .select("symbol", (F.col("pos") + 1).cast("int").alias("h"),
                        F.date_add(F.lit(as_of), F.col("pos") + 1).alias("target_date"),
                        "prediction"))


# --- models of all features ----------------------------------------------------------

def training_frame(features: DataFrame, window: int, as_of: dt.date, causal: bool = True) -> DataFrame:
    """Model inputs and Close of the training window, with the raw bars as ``bar_*``."""
    raw = features.where(F.col("Datetime") <= F.lit(as_of)).withColumns(
        {f"bar_{c}": F.col(c) for c in feat.BAR_COLS})
    rows = feat.causal_features(raw) if causal else raw
    return train_window(rows, window, order="Datetime")


FACTOR_ROWS = 512         # rows of one factor of the part of the window that stays


def _training(features: DataFrame, window: int, as_of: dt.date, causal: bool, cols: list[str]) -> DataFrame:
    """The training window as (symbol, Datetime, y, x, trend, bars), written once: the
    fit and the state both read it."""
    return stored(training_frame(features, window, as_of, causal).select(
        "symbol", "Datetime", F.col("Close").cast("double").alias("y"), fa.inputs(cols).alias("x"), "trend",
        *[F.col(f"bar_{c}").alias(c) for c in feat.BAR_COLS]), "training")


def _refit_daily(held: DataFrame, horizon: int, as_of: dt.date, cal: list[dt.date], window: int,
                 scenarios: int, noise_scale: float, seed: int, causal: bool, clip: bool,
                 cols: list[str]) -> DataFrame:
    """Of the training window, the rows that stay to the end are merged into factors by
    Spark; a path gets these, the at most ``horizon`` rows that the window will drop, and
    the series' last bars."""
    width = len(cols)
    series = Window.partitionBy("symbol")
    rows = held.select("symbol", "y", "x", (F.row_number().over(series.orderBy("Datetime")) - 1).alias("i"),
                       F.count(F.lit(1)).over(series).alias("m"))
    leaves = F.col("i") < F.col("m") + F.lit(horizon - 1 - window)

    def factor(key: tuple, table: pa.Table) -> pa.Table:
        return fa.factor(table, width).append_column("symbol", pa.array([key[0].as_py()], pa.string()))
    factors = (rows.where(~leaves).select("symbol", "y", "x", F.floor(F.col("i") / F.lit(FACTOR_ROWS)).alias("block"))
               .groupBy("symbol", "block").applyInArrow(factor, f"{fa.FACTOR_SCHEMA}, symbol string")
               .groupBy("symbol").agg(F.sum("n").alias("kept"), F.flatten(F.collect_list("r")).alias("factors")))
    every = F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))).alias("scenario")
    states = rollout.state(held, window, as_of).join(factors, "symbol", "left").select("*", every)

    def per_path(key: tuple, left: pa.Table, first: pa.Table) -> pa.Table:
        first = first.sort_by("i")
        kept = left["kept"][0].as_py() or 0
        base = fa.triangle(fa.stacked(left["factors"], width)) if kept else None
        held = fa.SlidingFactor(fa.design(fa.matrix(first["x"], width), first["y"].to_numpy()), base, kept)

        def refit(x: np.ndarray, _: dict) -> np.ndarray:
            """The day's fit: the oldest row goes, the window's factor is solved."""
            while len(held) > window:
                held.drop()
            coef = held.solve()
            y = float(coef[0] + x[0] @ coef[1:])
            if clip:
                y = min(max(y, rec.MIN_PRICE), ceiling)
            held.push(np.concatenate([[1.0], x[0], [y]]))
            return np.array([y])
        ceiling = max(left["max_price"][0].as_py(), rec.PRICE_CEILING_FLOOR)
        return pa.Table.from_batches([rollout.roll_table(left, rollout.Predictor(refit, []), cols, horizon, as_of,
                                                         cal, causal, noise_scale, seed, clip)])
    first = rows.where(leaves).select(F.col("symbol").alias("_series"), "i", "y", "x", every)
    return states.groupBy("symbol", "scenario").cogroup(first.groupBy("_series", "scenario")) \
        .applyInArrow(per_path, rollout.PATH_SCHEMA)


def recursive_forecast_ols(features: DataFrame, horizon: int, as_of: dt.date,
                           cal: list[dt.date], window: int = 1095, scenarios: int = 1,
                           noise_scale: float = 0.0, seed: int = 42, refit: bool = True,
                           causal: bool = True, cols: list[str] | None = None,
                           clip: bool = True) -> DataFrame:
    """Least-squares recursion for every (symbol, scenario); ``features`` is the
    as-is table, whose raw bars both feature sets are built from. ``clip`` keeps
    predictions in the price range ``[1, max(history max, 1e6)]``: a fit with many
    collinear inputs may feed back on itself without bound.

    With ``refit`` every path fits anew each day on the last ``window`` rows: a sliding
    window of mergeable factors (``factors.py``), so a day costs a merge and a small
    solve. Without it, one fit per series is joined to the series' one-row state and
    rolled forward (``rollout.py``); scenarios are made from that row.
    """
    cols = cols or feat.feature_columns(features)
    held = _training(features, window, as_of, causal, cols)
    if refit:
        return _refit_daily(held, horizon, as_of, cal, window, scenarios, noise_scale, seed, causal, clip, cols)
    from daycast.operators.models import fit_rows
    coefs = fit_rows(held.select("symbol", "y", "x"), len(cols)).drop("n_rows")
    rows = rollout.state(held, window, as_of).join(coefs, "symbol")
    return rollout.roll(rows, rollout.linear(), cols, horizon, as_of, cal, causal, noise_scale, seed, clip,
                        scenarios)


LAG_COLS = ["Close_lag_1", "Close_lag_3"]


def recursive_forecast_lags(features: DataFrame, horizon: int, as_of: dt.date, cal: list[dt.date],
                            window: int = 1095, refit: bool = False) -> DataFrame:
    """The recursion on two lags of Close."""
    return recursive_forecast_ols(features, horizon, as_of, cal, window, refit=refit, cols=LAG_COLS,
                                  clip=False)


QUANTILE_ACCURACY = 1000


def scenario_forecast(features: DataFrame, horizon: int, as_of: dt.date,
                      cal: list[dt.date], scenarios: int = 16, window: int = 1095,
                      noise_scale: float = rec.NOISE_FACTOR, seed: int = 42,
                      refit: bool = False, causal: bool = True, cols: list[str] | None = None,
                      clip: bool = True, accuracy: int = QUANTILE_ACCURACY) -> DataFrame:
    """Seeded noise paths per series, then the median and 10/90% quantiles of each day.

    The quantiles come from a mergeable summary per (symbol, day), combined before the
    shuffle: a quantile's rank is off by at most 1 / ``accuracy`` of the number of paths,
    and it is a value that a path has; up to ``accuracy`` paths it is exact.
    """
    paths = recursive_forecast_ols(features, horizon, as_of, cal, window, scenarios,
                                   noise_scale, seed, refit, causal, cols, clip)
    return (paths.groupBy("symbol", "h", "target_date")
            .agg(F.percentile_approx("prediction", [0.1, 0.5, 0.9], accuracy).alias("_q"),
                 F.count(F.lit(1)).alias("paths"))
            .select("symbol", "h", "target_date", *[F.col("_q")[k].alias(n) for k, n in enumerate(("p10", "p50", "p90"))],
                    "paths"))
