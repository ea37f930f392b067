"""The feature table in the Column API: the readable form the SQL text is checked against."""
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daycast.functions import calendar as cal_fn
from daycast.functions.windows import series_window, trend_index
from daycast.operators import features as feat


def feature_table_columns_api(bars: DataFrame, calendar: list[dt.date] | None = None,
                              fill: float | None = 0.0, date_col: str = "Date") -> DataFrame:
    """The same table built with the Column API (kept as the readable
    specification; tests check it equals ``feature_table``)."""
    dates = cal_fn.reference_calendar() if calendar is None else calendar
    w = series_window("symbol", date_col)
    d = F.col(date_col)
    cols: dict[str, Column] = {
        "symbol": F.col("symbol"),
        "Datetime": d,
    }
    for c in feat.BAR_COLS:
        cols[c] = feat._fill(F.col(c), fill)
    cols["trend"] = trend_index(w)
    cols.update(feat.calendar_part_exprs(d))
    for name, expr in feat.event_exprs(d, dates).items():
        cols[name] = expr if name == "halving_event" else feat._fill(expr, fill)
    for name, expr in feat.window_feature_exprs(w).items():
        cols[name] = feat._fill(expr, fill)
    for name, expr in feat.derived_exprs().items():
        cols[name] = feat._fill(expr, fill)
    return bars.select(*[e.alias(n) for n, e in cols.items()])


def causal_features_columns_api(features: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Column-API form of ``causal_features`` (tests check they agree)."""
    w = series_window("symbol", "Datetime")
    shifted = {c: feat._fill(F.lag(F.col(c), 1).over(w), fill) for c in feat.same_day_columns()}
    return features.withColumns(shifted)
