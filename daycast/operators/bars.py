"""Daily OHLCV bars from ticks.

One ``groupBy(symbol, day)``: Catalyst runs it as a partial aggregate in
every scan task and a final aggregate after one exchange, so a hot symbol
(even a third of all ticks) is combined map-side down to one row per
(task, symbol, day) before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from daycast.functions.values import epoch_micros, no_nan


def tick_order_key(ts: str, seq: str | None, dtype: T.DataType | None = None) -> Column:
    """Order of ticks inside a day: time first, then the sequence number.

    Packed into one DECIMAL(38,0) = micros * 10^20 + (seq + 2^63 + 1), which
    orders exactly like (ts, seq) for any timestamp up to year 9999 and any
    long seq; a null seq (0) comes before all others of its time. A decimal aggregation buffer is mutable in place, so
    ``min_by/max_by`` run as a hash aggregate (a struct key would force a
    sort-based aggregate in every scan task).
    """
    micros = epoch_micros(F.col(ts), dtype or T.TimestampNTZType())
    if seq is None:
        return micros
    return (micros.cast("decimal(38,0)") * F.expr("CAST(1e20 AS DECIMAL(38,0))")
            + F.coalesce(F.col(seq).cast("decimal(38,0)") + F.expr("CAST(9223372036854775809 AS DECIMAL(38,0))"),
                         F.lit(0).cast("decimal(38,0)")))


def daily_ohlcv(ticks: DataFrame, ts: str = "ts", seq: str | None = "seq",
                key: str = "symbol") -> DataFrame:
    """(symbol, ts, seq, Open..Volume) → one bar per (symbol, Date).

    Open is the first tick's Open and Close the last tick's Close by
    (ts, seq) — the value is kept even when null, as "first"/"last" do;
    High/Low skip null and NaN; Volume of a day with only null volume is 0.
    A tick without a time belongs to no day and fails the job.
    """
    day = F.coalesce(F.to_date(F.col(ts)), F.raise_error(F.lit("a tick has no time")).cast("date"))
    order = tick_order_key(ts, seq, ticks.schema[ts].dataType)
    return (ticks
            .groupBy(F.col(key).alias("symbol"), day.alias("Date"))
            .agg(F.min_by(F.col("Open"), order).alias("Open"),
                 F.max(no_nan(F.col("High"))).alias("High"),
                 F.min(no_nan(F.col("Low"))).alias("Low"),
                 F.max_by(F.col("Close"), order).alias("Close"),
                 F.coalesce(F.sum(F.col("Volume")), F.lit(0.0)).alias("Volume")))


def daily_range_volume(ticks: DataFrame, ts: str = "ts", key: str = "symbol") -> DataFrame:
    """Order-free part of a bar (High, Low, Volume, tick count).

    For sources without a tie-break key (repeated keys), where first/last
    are undefined. All buffers are primitive, so this is a hash aggregate.
    """
    return (ticks
            .groupBy(F.col(key).alias("symbol"), F.to_date(F.col(ts)).alias("Date"))
            .agg(F.max(no_nan(F.col("High"))).alias("High"),
                 F.min(no_nan(F.col("Low"))).alias("Low"),
                 F.coalesce(F.sum(F.col("Volume")), F.lit(0.0)).alias("Volume"),
                 F.count(F.lit(1)).alias("ticks")))


def price_history(bars: DataFrame, date_col: str = "Date", dedupe: bool = False) -> DataFrame:
    """(symbol, Date, Close), one row per date. Bars are unique per
    (symbol, Date) by construction, so the dedupe (a shuffle) is only
    for inputs that are not; sorting is left to the final output."""
    out = bars.select("symbol", F.col(date_col).alias("Date"), "Close")
    return out.dropDuplicates(["symbol", "Date"]) if dedupe else out


def sort_by_date(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """Final-output order (a range-partitioned sort; never mid-plan)."""
    return df.orderBy("symbol", date_col)
