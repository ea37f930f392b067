"""The wide daily feature table (76 reference columns + the series key).

All row windows share ``partitionBy(symbol).orderBy(Datetime)``; the whole
table is one projection over one Window operator, i.e. one exchange on
``symbol`` (free when the bars are already hash-partitioned by it) and
one sort. A series of *daily* bars is bounded by the number of days of
history, so a window partition never grows with tick volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from daycast.functions import calendar as cal_fn
from daycast.functions.values import iso_weekday
from daycast.functions.windows import lag_n, period_return, rolling_mean, rolling_std

# Column families and window sizes of the feature table.
PRICE_COLS = ["Open", "High", "Low", "Close"]
BAR_COLS = ["Open", "High", "Low", "Close", "Volume"]
LAGS = [1, 3, 7]
MA_WINDOWS = [3, 7, 14, 30]
STD_WINDOWS = [7, 30]
RETURN_PERIODS = [30, 90, 180]
MOMENTUM = (7, 30)
VOLUME_WINDOWS = [7, 30]
# Names of the event-calendar columns.
EVENT_COLS = ["halving_event", "days_since_last_halving", "days_until_next_halving",
              "halving_cycle", "post_halving_flag"]
# Columns that are never model inputs.
NON_FEATURES = ("symbol", "Datetime", "Timestamp", "Close")


# Column names of each family, in table order (pure Python, no session).
def lag_names() -> list[str]:
    return [f"{c}_lag_{n}" for c in BAR_COLS for n in LAGS]


def rolling_mean_names() -> list[str]:
    return [f"{c}_ma_{n}" for c in PRICE_COLS for n in MA_WINDOWS]


def rolling_std_names() -> list[str]:
    return [f"{c}_std_{n}" for c in PRICE_COLS for n in STD_WINDOWS]


def return_names() -> list[str]:
    return [f"{c}_return_{n}" for c in PRICE_COLS for n in RETURN_PERIODS]


def momentum_names() -> list[str]:
    return [f"{c}_momentum_{MOMENTUM[0]}_{MOMENTUM[1]}" for c in PRICE_COLS]


def volume_rolling_names() -> list[str]:
    return [f"Volume_{k}_{n}" for n in VOLUME_WINDOWS for k in ("ma", "std")]


DERIVED_NAMES = ["hl_range", "candle_body", "log_volume"]


def lag_exprs(w: WindowSpec) -> dict[str, Column]:
    return {f"{c}_lag_{n}": lag_n(c, n, w) for c in BAR_COLS for n in LAGS}


def rolling_mean_exprs(w: WindowSpec) -> dict[str, Column]:
    return {f"{c}_ma_{n}": rolling_mean(c, n, w) for c in PRICE_COLS for n in MA_WINDOWS}


def rolling_std_exprs(w: WindowSpec) -> dict[str, Column]:
    return {f"{c}_std_{n}": rolling_std(c, n, w) for c in PRICE_COLS for n in STD_WINDOWS}


def return_exprs(w: WindowSpec) -> dict[str, Column]:
    return {f"{c}_return_{n}": period_return(c, n, w) for c in PRICE_COLS for n in RETURN_PERIODS}


def momentum_exprs(w: WindowSpec) -> dict[str, Column]:
    short, long_ = MOMENTUM
    return {f"{c}_momentum_{short}_{long_}":
            rolling_mean(c, short, w) - rolling_mean(c, long_, w) for c in PRICE_COLS}


def volume_rolling_exprs(w: WindowSpec) -> dict[str, Column]:
    out = {}
    for n in VOLUME_WINDOWS:
        out[f"Volume_ma_{n}"] = rolling_mean("Volume", n, w)
        out[f"Volume_std_{n}"] = rolling_std("Volume", n, w)
    return out


def derived_exprs() -> dict[str, Column]:
    return {"hl_range": F.col("High") - F.col("Low"),
            "candle_body": F.col("Close") - F.col("Open"),
            "log_volume": F.log1p(F.col("Volume"))}


def calendar_part_exprs(d: Column) -> dict[str, Column]:
    return {"weekday": iso_weekday(d), "month": F.month(d).cast("int")}


def event_exprs(d: Column, dates: list[dt.date]) -> dict[str, Column]:
    cal = cal_fn.calendar_array(dates)
    return {"halving_event": cal_fn.event_flag(d, cal).cast("int"),
            "days_since_last_halving": cal_fn.days_since_event(d, cal),
            "days_until_next_halving": cal_fn.days_until_event(d, cal),
            "halving_cycle": cal_fn.event_cycle(d, cal),
            "post_halving_flag": cal_fn.post_event_flag(d, cal)}


def window_feature_exprs(w: WindowSpec) -> dict[str, Column]:
    """Every row-window column, in table order."""
    out = {}
    for part in (lag_exprs, rolling_mean_exprs, rolling_std_exprs, return_exprs,
                 momentum_exprs, volume_rolling_exprs):
        out.update(part(w))
    return out


def _fill(c: Column, value: float | None) -> Column:
    d = c.cast("double")
    if value is None:
        return d
    return F.coalesce(F.nanvl(d, F.lit(None).cast("double")), F.lit(float(value)))


# --- the whole table as Spark SQL expression text -------------------------------
# Building ~80 window/calendar columns through the Column API costs about a
# thousand py4j round trips (seconds of driver time per query); the same
# projection as expression text is parsed by the JVM in one ``selectExpr``
# call. Same semantics as the Column builders above (tests compare both).

def _q(name: str) -> str:
    return f"`{name}`"


def _over(date_col: str, n: int | None = None) -> str:
    frame = f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if n else ""
    return f"OVER (PARTITION BY symbol ORDER BY {_q(date_col)}{frame})"


def _sql_mean(c: str, n: int, d: str) -> str:
    return (f"CASE WHEN count({_q(c)}) {_over(d, n)} = {n} "
            f"THEN avg({_q(c)}) {_over(d, n)} END")


def _sql_std(c: str, n: int, d: str) -> str:
    return (f"CASE WHEN count({_q(c)}) {_over(d, n)} = {n} "
            f"THEN stddev_samp({_q(c)}) {_over(d, n)} END")


def _sql_fill(e: str, value: float | None) -> str:
    d = f"CAST(({e}) AS DOUBLE)"
    if value is None:
        return d
    return f"coalesce(nanvl({d}, CAST(NULL AS DOUBLE)), CAST({float(value)!r} AS DOUBLE))"


def feature_sql(dates: list[dt.date], fill: float | None = 0.0,
                date_col: str = "Date") -> list[str]:
    """``selectExpr`` list producing symbol + the 76 feature columns."""
    d = _q(date_col)
    cal = "array(" + ", ".join(f"DATE'{x.isoformat()}'" for x in sorted(dates)) + ")"
    if not dates:
        cal = "CAST(array() AS ARRAY<DATE>)"
    f = lambda e: _sql_fill(e, fill)
    cols: dict[str, str] = {"symbol": "symbol", "Datetime": d}
    for c in BAR_COLS:
        cols[c] = f(_q(c))
    cols["trend"] = f"CAST(row_number() {_over(date_col)} - 1 AS DOUBLE)"
    cols["weekday"] = f"CAST(weekday({d}) + 1 AS INT)"
    cols["month"] = f"CAST(month({d}) AS INT)"
    cols["halving_event"] = f"CAST(CASE WHEN array_contains({cal}, {d}) THEN 1 ELSE 0 END AS INT)"
    cols["days_since_last_halving"] = f(
        f"coalesce(datediff({d}, array_max(filter({cal}, h -> h <= {d}))), 0)")
    cols["days_until_next_halving"] = f(
        f"coalesce(datediff(array_min(filter({cal}, h -> h >= {d})), {d}), 0)")
    cols["halving_cycle"] = f(f"size(filter({cal}, h -> h <= {d}))")
    cols["post_halving_flag"] = f(
        f"CASE WHEN exists({cal}, h -> datediff({d}, h) BETWEEN 0 AND "
        f"{cal_fn.POST_EVENT_DAYS}) THEN 1 ELSE 0 END")
    for c in BAR_COLS:
        for n in LAGS:
            cols[f"{c}_lag_{n}"] = f(f"lag({_q(c)}, {n}) {_over(date_col)}")
    for c in PRICE_COLS:
        for n in MA_WINDOWS:
            cols[f"{c}_ma_{n}"] = f(_sql_mean(c, n, date_col))
    for c in PRICE_COLS:
        for n in STD_WINDOWS:
            cols[f"{c}_std_{n}"] = f(_sql_std(c, n, date_col))
    for c in PRICE_COLS:
        for n in RETURN_PERIODS:
            cols[f"{c}_return_{n}"] = f(
                f"try_divide({_q(c)}, lag({_q(c)}, {n}) {_over(date_col)}) - 1")
    s_, l_ = MOMENTUM
    for c in PRICE_COLS:
        cols[f"{c}_momentum_{s_}_{l_}"] = f(
            f"({_sql_mean(c, s_, date_col)}) - ({_sql_mean(c, l_, date_col)})")
    for n in VOLUME_WINDOWS:
        cols[f"Volume_ma_{n}"] = f(_sql_mean("Volume", n, date_col))
        cols[f"Volume_std_{n}"] = f(_sql_std("Volume", n, date_col))
    cols["hl_range"] = f("`High` - `Low`")
    cols["candle_body"] = f("`Close` - `Open`")
    cols["log_volume"] = f("log1p(`Volume`)")
    return [f"{e} AS {_q(n)}" for n, e in cols.items()]


def feature_table(bars: DataFrame, calendar: list[dt.date] | None = None,
                  fill: float | None = 0.0, date_col: str = "Date") -> DataFrame:
    """Daily bars (symbol, Date, OHLCV) → symbol + the 76 feature columns.

    ``fill=0.0`` turns incomplete windows, missing lags and NaN into 0 as
    the reference table does; ``fill=None`` keeps them null. One projection,
    one Window operator.
    """
    dates = cal_fn.reference_calendar() if calendar is None else calendar
    # Rename first so the windows sort on (symbol, Datetime): downstream
    # series windows (training window, causal shift, folds) then reuse
    # that order instead of sorting again.
    if date_col != "Datetime":
        bars = bars.withColumnRenamed(date_col, "Datetime")
    return bars.selectExpr(*feature_sql(dates, fill, "Datetime"))


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: every column but the key, dates and the target."""
    return [c for c in df.columns if c not in NON_FEATURES]


# Columns computed from the same day's prices (leak the same-day Close).
def same_day_columns() -> list[str]:
    cols = [c for c in BAR_COLS if c != "Close"]
    for part in (rolling_mean_names, rolling_std_names, return_names, momentum_names,
                 volume_rolling_names):
        cols += part()
    return cols + DERIVED_NAMES


def causal_features(features: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Shift every same-day price column one row back, so each row only
    sees data up to the day before its target ``Close`` (no leakage).
    Lags, trend and calendar columns are already known the day before.
    One ``selectExpr`` projection (one Window on the same partitioning)."""
    shifted = set(same_day_columns())
    over = _over("Datetime")
    exprs = [f"{_sql_fill(f'lag({_q(c)}, 1) {over}', fill)} AS {_q(c)}" if c in shifted
             else _q(c) for c in features.columns]
    return features.selectExpr(*exprs)
