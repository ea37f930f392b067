"""Registered queries: bars, row windows, scalar and calendar features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daycast.functions.values import (any_nan_row, double_columns, fill_missing,
                                     ntz_epoch_micros)
from daycast.functions.windows import series_window, trend_index
from daycast.operators import event_table as et
from daycast.operators import features as feat
from daycast.operators.bars import price_history
from daycast.plans import common
from daycast.plans import oracle as O
from daycast.sources import raw
from daycast.sources.ticks import table


# --- step 1: sources and bars ------------------------------------------------

def q_daily_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.round_doubles(common.bars(spark, sf_dir))


def q_csv_daily_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a raw minute file with its columns in another order and two
    more, read back by name, and made into bars."""
    from daycast.operators.bars import daily_ohlcv
    from daycast.sources.ticks import orders_ticks
    from daycast.streaming.bars_stream import scratch_paths
    t = orders_ticks(spark, sf_dir)
    epoch = (ntz_epoch_micros(F.col("ts").cast("timestamp_ntz")) / F.lit(1e6)).alias("Timestamp")
    path, _ = scratch_paths(spark, "ohlcv_csv")
    t.select("Close", "symbol", "Low", epoch, "High", "seq", "Open", "Volume") \
        .write.option("header", True).csv(path)
    back = raw.epoch_to_ts(raw.epoch_seconds(raw.scan_ohlcv_csv(spark, path)), out="ts")
    return common.round_doubles(daily_ohlcv(back.withColumn("seq", F.col("seq").cast("long"))))


def _events_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a raw minute-style file: epoch seconds (fractional)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (ntz_epoch_micros(F.col("ts")) / F.lit(1e6)).alias("Timestamp"))


def q_check_epoch_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.epoch_unit_check(_events_epoch(spark, sf_dir)).select(
        F.round("max_epoch", 3).alias("max_epoch"), "is_seconds")


def q_epoch_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw.epoch_to_ts(_events_epoch(spark, sf_dir))
    return df.select("event_id", F.round("Timestamp", 3).alias("Timestamp"), "Datetime")


def q_daily_range_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free bars of the volume source (lineitem: no tie-break key).
    Not rounded: every double is one IEEE division or an exact max/min/sum
    of integers, bit-identical in any engine (rounding would only add
    half-up vs binary tie differences)."""
    from daycast.operators.bars import daily_range_volume
    from daycast.sources.ticks import lineitem_ticks
    return daily_range_volume(lineitem_ticks(spark, sf_dir))


def q_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.round_doubles(price_history(common.bars(spark, sf_dir)))


EPOCH_SQL = """epoch AS (
  SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS "Timestamp" FROM events)"""

SQL = {
    "daily_ohlcv": f"""WITH {O.BARS_CTE}
SELECT symbol, "Date", {O.r('"Open"')} AS "Open", {O.r('"High"')} AS "High",
       {O.r('"Low"')} AS "Low", {O.r('"Close"')} AS "Close", {O.r('"Volume"')} AS "Volume"
FROM bars""",
    "check_epoch_unit": f"""WITH {EPOCH_SQL}
SELECT {O.r('max("Timestamp")', 3)} AS max_epoch,
       coalesce(max("Timestamp") <= 1e12, true) AS is_seconds FROM epoch""",
    "epoch_to_ts": f"""WITH {EPOCH_SQL}
SELECT event_id, {O.r('"Timestamp"', 3)} AS "Timestamp",
       make_timestamp(CAST(round("Timestamp" * 1000000) AS BIGINT)) AS "Datetime" FROM epoch""",
    "price_history": f"""WITH {O.BARS_CTE}
SELECT symbol, "Date", {O.r('"Close"')} AS "Close" FROM bars""",
    "daily_range_volume": f"""WITH li AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS "Date",
         CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS px,
         CAST(l_quantity AS DOUBLE) AS vol FROM lineitem)
SELECT symbol, "Date", max(px) AS "High", min(px) AS "Low",
       coalesce(sum(vol), 0) AS "Volume", count(*) AS ticks
FROM li GROUP BY symbol, 2""",
}


# --- step 2 and 3: row windows and scalar features --------------------------

def _bars_with(spark, sf_dir, exprs: dict) -> DataFrame:
    b = common.bars(spark, sf_dir)
    return common.round_doubles(b.select("symbol", "Date", *[e.alias(n) for n, e in exprs.items()]))


def _window_query(part):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _bars_with(spark, sf_dir, part(series_window()))
    return run


def q_trend_index(spark, sf_dir):
    return _bars_with(spark, sf_dir, {"trend": trend_index(series_window())})


def q_calendar_parts(spark, sf_dir):
    return _bars_with(spark, sf_dir, feat.calendar_part_exprs(F.col("Date")))


def q_derived_ohlcv(spark, sf_dir):
    return _bars_with(spark, sf_dir, feat.derived_exprs())


def q_fill_missing(spark, sf_dir):
    """Lag columns with incomplete history filled with 0 (null and NaN)."""
    lags = _bars_with(spark, sf_dir, feat.lag_exprs(series_window()))
    names = feat.lag_names()
    return fill_missing(lags, names)


def q_feature_table(spark, sf_dir):
    return common.round_doubles(feat.feature_table(common.bars(spark, sf_dir), common.calendar()))


def q_assert_no_nan(spark, sf_dir):
    ft = feat.feature_table(common.bars(spark, sf_dir), common.calendar())
    return any_nan_row(ft, double_columns(ft))


def _sql_window_query(names: list[str]) -> str:
    exprs = O.window_feature_sql()
    cols = ",\n  ".join(f"{O.r(exprs[n])} AS {O.q(n)}" for n in names)
    return f"WITH {O.BARS_CTE}\nSELECT symbol, \"Date\",\n  {cols}\nFROM bars"


WINDOW_PARTS = {
    "lag_n": (feat.lag_exprs, feat.lag_names),
    "rolling_mean": (feat.rolling_mean_exprs, feat.rolling_mean_names),
    "rolling_std": (feat.rolling_std_exprs, feat.rolling_std_names),
    "period_return": (feat.return_exprs, feat.return_names),
    "momentum": (feat.momentum_exprs, feat.momentum_names),
    "volume_rolling": (feat.volume_rolling_exprs, feat.volume_rolling_names),
}

for _key, (_part, _names) in WINDOW_PARTS.items():
    SQL[_key] = _sql_window_query(_names())

SQL["csv_daily_ohlcv"] = SQL["daily_ohlcv"]
SQL["trend_index"] = f"""WITH {O.BARS_CTE}
SELECT symbol, "Date", CAST(row_number() OVER ({O.W}) - 1 AS DOUBLE) AS trend FROM bars"""
SQL["calendar_parts"] = f"""WITH {O.BARS_CTE}
SELECT symbol, "Date", CAST(isodow("Date") AS INTEGER) AS weekday,
       CAST(month("Date") AS INTEGER) AS month FROM bars"""
SQL["derived_ohlcv"] = f"""WITH {O.BARS_CTE}
SELECT symbol, "Date", """ + ", ".join(
    f"{O.r(e)} AS {O.q(n)}" for n, e in O.derived_sql().items()) + "\nFROM bars"
SQL["fill_missing"] = f"""WITH {O.BARS_CTE}
SELECT symbol, "Date", """ + ", ".join(
    f"{O.fill(O.r(O.lag_sql(c, n)))} AS {O.q(f'{c}_lag_{n}')}"
    for c in feat.BAR_COLS for n in feat.LAGS) + "\nFROM bars"
SQL["feature_table"] = f"""WITH {O.features_cte()}
SELECT
  """ + O.select_rounded({n: O.q(n) for n in O.feature_table_exprs()}, O.feature_doubles()) + \
    "\nFROM features"
SQL["assert_no_nan"] = f"""WITH {O.features_cte()}
SELECT """ + ", ".join(
    f"coalesce(bool_or(isnan({O.q(n)}) OR {O.q(n)} IS NULL), false) AS {O.q(n)}"
    for n in O.feature_table_exprs() if n in O.feature_doubles() or n in
    ("Open", "High", "Low", "Close", "Volume")) + "\nFROM features"


# --- step 4: event calendar ---------------------------------------------------

EVENT_KEYS = {
    "event_flag": "halving_event",
    "days_since_event": "days_since_last_halving",
    "days_until_event": "days_until_next_halving",
    "event_cycle": "halving_cycle",
    "post_event_flag": "post_halving_flag",
}


def _event_query(col_name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        exprs = feat.event_exprs(F.col("Date"), common.calendar())
        return _bars_with(spark, sf_dir, {col_name: exprs[col_name]})
    return run


for _key, _col in EVENT_KEYS.items():
    SQL[_key] = (f"WITH {O.BARS_CTE},\n{O.calendar_cte(common.calendar())}\n"
                 f"SELECT symbol, \"Date\", {O.event_sql(_col)} AS {O.q(_col)} FROM bars")


# --- step 4b: events as a table ------------------------------------------------

# An order of this price or more makes its day an event of its priority class.
EVENT_PRICE = 450_000.0
EVENT_REACH = 3                # days after an event that are flagged


def _large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").where(F.col("o_totalprice") >= EVENT_PRICE)
    return t.select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("event_date"))


def _event_table_query(name: str, by: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        days = common.bars(spark, sf_dir).select("symbol", "Date")
        out = et.as_of_events(days, _large_orders(spark, sf_dir), by=by)
        return out.select("symbol", "Date", et.event_columns()[name].alias(name))
    return run


def q_post_event_flag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = common.bars(spark, sf_dir).select("symbol", "Date")
    return et.post_events(days, _large_orders(spark, sf_dir), EVENT_REACH, by=["symbol"])


# The first three are per series, the cycle counts the events of all series.
EVENT_TABLE_KEYS = {"event_flag": ["symbol"], "days_since_event": ["symbol"], "days_until_event": ["symbol"],
                    "event_cycle": []}

_EVENTS_SQL = f"""WITH {O.BARS_CTE},
events AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS e FROM orders WHERE o_totalprice >= {EVENT_PRICE})
SELECT b.symbol, b."Date", """
SQL["event_flag_table"] = _EVENTS_SQL + """CAST(EXISTS (SELECT 1 FROM events e
  WHERE e.symbol = b.symbol AND e.e = b."Date") AS INTEGER) AS event_flag FROM bars b"""
SQL["days_since_event_table"] = _EVENTS_SQL + """CAST(coalesce(b."Date" - (SELECT max(e.e) FROM events e
  WHERE e.symbol = b.symbol AND e.e <= b."Date"), 0) AS BIGINT) AS days_since_event FROM bars b"""
SQL["days_until_event_table"] = _EVENTS_SQL + """CAST(coalesce((SELECT min(e.e) FROM events e
  WHERE e.symbol = b.symbol AND e.e >= b."Date") - b."Date", 0) AS BIGINT) AS days_until_event FROM bars b"""
SQL["event_cycle_table"] = _EVENTS_SQL + """CAST((SELECT count(*) FROM events e
  WHERE e.e <= b."Date") AS BIGINT) AS event_cycle FROM bars b"""
SQL["post_event_flag_table"] = _EVENTS_SQL + f"""CAST(EXISTS (SELECT 1 FROM events e
  WHERE e.symbol = b.symbol AND b."Date" - e.e BETWEEN 0 AND {EVENT_REACH}) AS BIGINT) AS post_event_flag FROM bars b"""


QUERIES = {
    "daily_ohlcv": q_daily_ohlcv,
    "csv_daily_ohlcv": q_csv_daily_ohlcv,
    "check_epoch_unit": q_check_epoch_unit,
    "epoch_to_ts": q_epoch_to_ts,
    "price_history": q_price_history,
    "daily_range_volume": q_daily_range_volume,
    "trend_index": q_trend_index,
    **{k: _window_query(p) for k, (p, _) in WINDOW_PARTS.items()},
    "calendar_parts": q_calendar_parts,
    "derived_ohlcv": q_derived_ohlcv,
    "fill_missing": q_fill_missing,
    "assert_no_nan": q_assert_no_nan,
    "feature_table": q_feature_table,
    **{k: _event_query(c) for k, c in EVENT_KEYS.items()},
    **{f"{k}_table": _event_table_query(k, by) for k, by in EVENT_TABLE_KEYS.items()},
    "post_event_flag_table": q_post_event_flag_table,
}
