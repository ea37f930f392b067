"""Daily bars on a hand-made tick frame (ties, null, NaN, empty volume)."""
import datetime as dt
import math

from daycast.operators.bars import daily_ohlcv, price_history
from daycast.sources.schemas import TICKS

T = dt.datetime


def ticks(spark, rows):
    return spark.createDataFrame(rows, TICKS)


def test_first_last_break_ties_on_seq(spark):
    rows = [("A", T(2024, 1, 1, 9), 2, 10.0, 11.0, 9.0, 10.5, 1.0),
            ("A", T(2024, 1, 1, 9), 1, 20.0, 21.0, 19.0, 20.5, 2.0),
            ("A", T(2024, 1, 1, 17), 3, 30.0, 31.0, 29.0, 30.5, 3.0)]
    b = daily_ohlcv(ticks(spark, rows)).collect()[0]
    assert b["Open"] == 20.0          # same ts: lower seq is first
    assert b["Close"] == 30.5
    assert b["High"] == 31.0 and b["Low"] == 9.0 and b["Volume"] == 6.0


def test_null_open_is_kept_and_nan_high_skipped(spark):
    rows = [("A", T(2024, 1, 2, 9), 1, None, float("nan"), 5.0, 6.0, None),
            ("A", T(2024, 1, 2, 10), 2, 7.0, 8.0, 4.0, 7.5, None)]
    b = daily_ohlcv(ticks(spark, rows)).collect()[0]
    assert b["Open"] is None          # "first" keeps a null value
    assert b["High"] == 8.0           # NaN ignored like null
    assert b["Volume"] == 0.0         # all-null volume sums to 0


def test_one_row_day_and_sorted_history(spark):
    rows = [("B", T(2024, 1, 3, 12), 1, 1.0, 2.0, 0.5, 1.5, 4.0),
            ("B", T(2024, 1, 1, 12), 2, 3.0, 4.0, 2.5, 3.5, 1.0)]
    b = daily_ohlcv(ticks(spark, rows))
    assert b.count() == 2
    ph = price_history(b).orderBy("Date").collect()
    assert [r["Date"] for r in ph] == [dt.date(2024, 1, 1), dt.date(2024, 1, 3)]
    assert not any(math.isnan(r["Close"]) for r in ph)
