"""Expanding folds against a brute-force split; metric edge cases."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from daycast.functions.values import mae, mape, rmse
from daycast.operators import folds as fo


def brute_force_split(n, k):
    ts = n // (k + 1)
    out = []
    for f in range(k):
        start = n - (k - f) * ts
        out.append((list(range(start)), list(range(start, start + ts))))
    return out


@pytest.mark.parametrize("n", [6, 7, 23, 100])
def test_folds_equal_brute_force(spark, n):
    k = 5
    df = spark.createDataFrame([("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i))
                                for i in range(n)], "symbol string, Date date, Close double")
    rows = fo.expanding_folds(df, k).collect()
    for f, (train, test) in enumerate(brute_force_split(n, k)):
        got_tr = sorted(r["i"] for r in rows if r["fold"] == f and r["role"] == "train")
        got_te = sorted(r["i"] for r in rows if r["fold"] == f and r["role"] == "test")
        assert got_tr == train and got_te == test
        assert max(got_tr) < min(got_te)          # train always before test


def test_too_short_series_is_kept_without_a_fold(spark):
    df = spark.createDataFrame([("S", dt.date(2024, 1, i + 1), 1.0) for i in range(5)],
                               "symbol string, Date date, Close double")
    got = fo.expanding_folds(df, 5).collect()
    assert len(got) == 5 and {(r["fold"], r["role"]) for r in got} == {(None, "short")}


def test_cv_trend_ols_perfect_line(spark):
    df = spark.createDataFrame([("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), 3.0 + 2.0 * i)
                                for i in range(60)], "symbol string, Date date, Close double")
    res = fo.cv_trend_ols(df, 5).collect()
    assert len(res) == 5
    assert all(r["MAE"] == pytest.approx(0.0, abs=1e-6) for r in res)


def test_mape_null_with_zero_actual(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    r = df.agg(mae(F.col("y"), F.col("p")).alias("a"), rmse(F.col("y"), F.col("p")).alias("b"),
               mape(F.col("y"), F.col("p")).alias("c")).collect()[0]
    assert r["a"] == 1.0 and r["b"] == 1.0 and r["c"] is None


def test_metrics_for_one_day_and_cast_float(spark):
    from daycast.functions.values import cast_float
    from daycast.operators.evaluation import metrics_for_day
    fva = spark.createDataFrame(
        [("S", "m", dt.date(2024, 1, 1), dt.date(2023, 12, 1), 100.0, 90.0),
         ("S", "m", dt.date(2024, 1, 2), dt.date(2023, 12, 1), 0.0, 5.0),
         ("S", "n", dt.date(2024, 1, 1), dt.date(2023, 12, 1), 100.0, 50.0)],
        "symbol string, model string, target_date date, run_date date, actual double, "
        "predicted double")
    r = metrics_for_day(fva, "m", dt.date(2024, 1, 1)).collect()
    assert len(r) == 1 and r[0]["MAE"] == 10.0 and r[0]["RMSE"] == 10.0
    assert r[0]["MAPE"] == pytest.approx(10.0)
    z = metrics_for_day(fva, "m", dt.date(2024, 1, 2)).collect()[0]
    assert z["MAPE"] is None                     # actual 0 → no percentage error
    txt = spark.createDataFrame([("1.5",), ("x",)], "v string")
    assert [row["v"] for row in cast_float(txt, ["v"], strict=False).collect()] == [1.5, None]


def test_cv_trend_ols_equals_numpy_per_fold(spark):
    import numpy as np
    from conftest import SMALL
    from daycast.plans import common
    bars = common.bars(spark, SMALL)
    got = {(r["symbol"], r["fold"]): r for r in fo.cv_trend_ols(bars, 5).collect()}
    pdf = bars.toPandas()
    for sym, g in pdf.groupby("symbol"):
        y = g.sort_values("Date")["Close"].to_numpy()
        dates = g.sort_values("Date")["Date"].to_numpy()
        for f, (train, test) in enumerate(brute_force_split(len(y), 5)):
            b, a = np.polyfit(np.array(train, float), y[train], 1)
            p = a + b * np.array(test, float)
            r = got[(sym, f)]
            assert r["MAE"] == pytest.approx(np.mean(np.abs(y[test] - p)), rel=1e-9)
            assert r["RMSE"] == pytest.approx(np.sqrt(np.mean((y[test] - p) ** 2)), rel=1e-9)
            assert r["train_end"] == dates[train[-1]] and r["test_start"] == dates[test[0]]
