"""Expanding-window time-series folds and the one-query trend-OLS CV.

Folds follow the expanding split: with n rows in a series and k folds,
``ts = n div (k+1)``; fold f tests rows ``start_f <= i < start_f + ts``
with ``start_f = n - (k - f) * ts`` and trains on every row ``i < start_f``.

``expanding_folds`` lists each row once per fold it belongs to (at most
k); its later aggregates are keyed by (symbol, fold), which the hash
partitioning on ``symbol`` already satisfies. ``cv_trend_ols`` needs no
such copies: every training set is a prefix, so one running regression
over the (symbol, date) order serves all folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daycast.functions.values import mae, mape, rmse


def expanding_folds(df: DataFrame, k: int = 5, key: str = "symbol",
                    order: str = "Date") -> DataFrame:
    """df → df + (i, n, fold, role) with one row per (row, fold) it takes part in.

    ``role`` is 'train' or 'test'. The split is undefined for series with fewer
    than k+1 rows: these keep each row once, with a null fold and role 'short'.
    """
    w = Window.partitionBy(key).orderBy(order)
    wall = Window.partitionBy(key)
    base = (df.withColumn("i", (F.row_number().over(w) - 1).cast("long"))
              .withColumn("n", F.count(F.lit(1)).over(wall)))
    ts = F.floor(F.col("n") / F.lit(k + 1)).cast("long")
    start = F.col("n") - (F.lit(k) - F.col("fold")) * ts
    role = (F.when(F.col("fold").isNull(), F.lit("short"))
             .when(F.col("i") < start, F.lit("train"))
             .when(F.col("i") < start + ts, F.lit("test")))
    folds = F.when(ts > 0, F.sequence(F.lit(0), F.lit(k - 1)))
    return (base.withColumn("fold", F.explode_outer(folds))
                .withColumn("role", role)
                .where(F.col("role").isNotNull()))


def fold_bounds(folds: DataFrame, key: str = "symbol", order: str = "Date") -> DataFrame:
    """First/last date and size of the train and test part of every fold."""
    tr = F.col("role") == "train"
    te = F.col("role") == "test"
    return folds.groupBy(key, "fold").agg(
        F.min(F.when(tr, F.col(order))).alias("train_start"),
        F.max(F.when(tr, F.col(order))).alias("train_end"),
        F.min(F.when(te, F.col(order))).alias("test_start"),
        F.max(F.when(te, F.col(order))).alias("test_end"),
        F.count(F.when(tr, 1)).alias("n_train"),
        F.count(F.when(te, 1)).alias("n_test"))


def fold_metrics(scored: DataFrame, y: str = "y", p: str = "p",
                 key: str = "symbol", order: str = "Date") -> DataFrame:
    """MAE / RMSE / MAPE and fold bounds from (key, fold, role, order, y, p) rows
    (test rows carry the prediction, train rows only their dates)."""
    te = F.col("role") == "test"
    tr = F.col("role") == "train"
    yt = F.when(te, F.col(y))
    pt = F.when(te, F.col(p))
    return scored.groupBy(key, "fold").agg(
        F.min(F.when(tr, F.col(order))).alias("train_start"),
        F.max(F.when(tr, F.col(order))).alias("train_end"),
        F.min(F.when(te, F.col(order))).alias("test_start"),
        F.max(F.when(te, F.col(order))).alias("test_end"),
        mae(yt, pt).alias("MAE"),
        rmse(yt, pt).alias("RMSE"),
        mape_test(F.col(y), F.col(p), te).alias("MAPE"))


def mape_test(y: Column, p: Column, te: Column) -> Column:
    """MAPE over the test rows only; null if any test actual is 0."""
    return F.when(F.bool_and(F.when(te, y != 0)),
                  F.avg(F.when(te, F.abs(F.try_divide(y - p, y)))) * F.lit(100.0))


def cv_trend_ols(df: DataFrame, k: int = 5, target: str = "Close", key: str = "symbol",
                 order: str = "Date") -> DataFrame:
    """Cross-validate ``target ~ a + b * trend`` on expanding folds, all
    series and folds in one query, without copying rows per fold.

    Every fold trains on a prefix of its series (rows ``i < start_f``), so
    one running ``regr_slope/regr_intercept`` over the (symbol, date) order
    holds every fold's fit: the fit of fold f is the running value at row
    ``start_f - 1``, carried forward to the fold's test rows with
    ``last(..., ignorenulls)``. One sort, no explode, no join, no Python.
    """
    w = Window.partitionBy(key).orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    series = Window.partitionBy(key)
    base = df.select(key, order, F.col(target).alias("_y"),
                     (F.row_number().over(w) - 1).cast("long").alias("i"),
                     F.count(F.lit(1)).over(series).alias("n"),
                     F.min(order).over(series).alias("train_start"))
    ts = F.floor(F.col("n") / F.lit(k + 1)).cast("long")
    # null where the series is too short: its rows end up as one row without a fold
    base = base.withColumn("_ts", F.when(ts > 0, ts))
    x = F.col("i").cast("double")
    back = F.col("n") - 1 - F.col("i")           # rows after this one
    fit_end = ((back % F.col("_ts")) == 0) & (back >= F.col("_ts")) & \
        (back <= F.lit(k) * F.col("_ts"))        # row start_f - 1 of some fold
    marked = base.withColumns({
        "_b": F.when(fit_end, F.regr_slope("_y", x).over(running)),
        "_a": F.when(fit_end, F.regr_intercept("_y", x).over(running)),
        "_d": F.when(fit_end, F.col(order)),
    })
    carried = marked.withColumns({
        "b": F.last("_b", ignorenulls=True).over(before),
        "a": F.last("_a", ignorenulls=True).over(before),
        "train_end": F.last("_d", ignorenulls=True).over(before),
    })
    first_test = F.col("n") - F.lit(k) * F.col("_ts")
    short = F.col("_ts").isNull()
    test = (carried.where(short | (F.col("i") >= first_test))
                   .withColumn("fold", F.floor((F.col("i") - first_test) / F.col("_ts"))
                               .cast("int"))
                   .withColumn("p", F.col("a") + F.col("b") * x))
    y, p = F.when(~short, F.col("_y")), F.col("p")
    return test.groupBy(key, "fold").agg(
        F.min(F.when(~short, F.col("train_start"))).alias("train_start"),
        F.max("train_end").alias("train_end"),
        F.min(F.when(~short, F.col(order))).alias("test_start"),
        F.max(F.when(~short, F.col(order))).alias("test_end"),
        mae(y, p).alias("MAE"),
        rmse(y, p).alias("RMSE"),
        mape(y, p).alias("MAPE"))
