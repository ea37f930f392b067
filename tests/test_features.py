"""Row-window edges and the event calendar on hand-made frames."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

import column_api
from daycast.functions import calendar as C
from daycast.functions.windows import period_return, rolling_mean, rolling_std, series_window
from daycast.operators import features as feat

D = dt.date


def _same_rows(a, b):
    import pandas as pd
    key = ["symbol", "Datetime"]
    pa = a.toPandas().sort_values(key).reset_index(drop=True)
    pb = b.toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(pa, pb, check_exact=True)


def bars(spark, closes, symbol="S"):
    rows = [(symbol, D(2024, 1, 1) + dt.timedelta(days=i), c, c, c, c, 1.0)
            for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, Date date, Open double, High double, "
                                       "Low double, Close double, Volume double")


def test_rolling_mean_null_until_full_and_null_inside(spark):
    df = bars(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    w = series_window()
    out = df.select("Date", rolling_mean("Close", 3, w).alias("m")).orderBy("Date").collect()
    ms = [r["m"] for r in out]
    assert ms[:2] == [None, None]                # fewer rows than the window
    assert ms[2:5] == [None, None, None]         # a null inside the window
    assert ms[5] == pytest.approx(5.0)


def test_rolling_std_is_sample(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0])
    out = df.select("Date", rolling_std("Close", 4, series_window()).alias("s")) \
            .orderBy("Date").collect()
    assert out[-1]["s"] == pytest.approx(1.2909944487358056)


def test_zero_lag_return_is_null_then_zero(spark):
    df = bars(spark, [0.0, 5.0])
    r = df.select("Date", period_return("Close", 1, series_window()).alias("r")) \
          .orderBy("Date").collect()
    assert r[1]["r"] is None                      # x / 0 → null (ANSI-safe)
    ft = feat.feature_table(df, [D(2020, 1, 1)])
    assert all(v == 0.0 for v in ft.select("Close_return_30").toPandas()["Close_return_30"])


def test_feature_table_shape(spark):
    df = bars(spark, [float(i + 1) for i in range(40)])
    ft = feat.feature_table(df, C.testdata_calendar())
    assert len(ft.columns) == 77                  # symbol + the 76 reference columns
    assert len(feat.feature_columns(ft)) == 74
    row = ft.orderBy("Datetime").collect()[-1]
    assert row["Close_lag_1"] == 39.0 and row["Close_ma_3"] == pytest.approx(39.0)
    assert row["Close_momentum_7_30"] == pytest.approx(row["Close_ma_7"] - row["Close_ma_30"])
    assert row["trend"] == 39.0


@pytest.mark.parametrize("day, flag, since, until, cycle, post", [
    (D(2011, 1, 1), 0, 0, 697, 0, 0),      # before the first event
    (D(2012, 11, 28), 1, 0, 0, 1, 1),      # day 0
    (D(2013, 11, 28), 0, 365, 1096, 1, 1),  # day 365: still inside
    (D(2013, 11, 29), 0, 366, 1095, 1, 0),  # day 366: outside
    (D(2050, 1, 1), 0, 399, 0, 10, 0),     # after the last event
])
def test_event_calendar_edges(spark, day, flag, since, until, cycle, post):
    cal = C.calendar_array(C.reference_calendar())
    d = F.lit(day)
    r = spark.range(1).select(C.event_flag(d, cal).alias("f"), C.days_since_event(d, cal).alias("s"),
                              C.days_until_event(d, cal).alias("u"), C.event_cycle(d, cal).alias("c"),
                              C.post_event_flag(d, cal).alias("p")).collect()[0]
    assert (r["f"], r["s"], r["u"], r["c"], r["p"]) == (flag, since, until, cycle, post)


def test_causal_features_do_not_see_the_future(spark):
    full = bars(spark, [float(i % 7 + 1) for i in range(60)])
    cut = full.where(F.col("Date") <= D(2024, 1, 1) + dt.timedelta(days=39))
    a = feat.causal_features(feat.feature_table(full, [])).where(
        F.col("Datetime") <= D(2024, 1, 1) + dt.timedelta(days=39))
    b = feat.causal_features(feat.feature_table(cut, []))
    _same_rows(a, b)


def test_sql_text_table_equals_column_api_table(spark):
    from conftest import SMALL
    from daycast.plans import common
    b = common.bars(spark, SMALL)
    a = feat.feature_table(b, C.testdata_calendar())
    c = column_api.feature_table_columns_api(b, C.testdata_calendar())
    assert a.columns == c.columns and a.dtypes == c.dtypes
    _same_rows(a, c)


def test_causal_sql_text_equals_column_api(spark):
    from conftest import SMALL
    from daycast.plans import common
    ft = feat.feature_table(common.bars(spark, SMALL), C.testdata_calendar())
    a, b = feat.causal_features(ft), column_api.causal_features_columns_api(ft)
    assert a.columns == b.columns and a.dtypes == b.dtypes
    _same_rows(a, b)
