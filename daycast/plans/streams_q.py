"""Registered queries: streaming bars and incremental features on events.

Each query runs a Structured Streaming job over the whole ``events``
table (``availableNow``), writes into a fresh folder under the shared
checkpoint directory and returns the sink read back as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from daycast.functions.values import utc_instant
from daycast.operators.features import feature_table
from daycast.plans import common
from daycast.plans import oracle as O
from daycast.streaming import bars_stream as bs
from daycast.sources.ticks import table

LATENESS = "1 day"


def _tick_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    # a glob names the one file (a plain file path is refused as a stream source)
    return _ticks(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"),
                  schema["ts"].dataType)


def _ticks(ev, ts_type):
    price = F.col("value").cast("double")
    return ev.select(F.col("event_type").alias("symbol"),
                     utc_instant(F.col("ts"), ts_type).alias("ts"),
                     F.col("event_id").alias("seq"),
                     price.alias("Open"), price.alias("High"), price.alias("Low"),
                     price.alias("Close"), F.lit(1.0).alias("Volume"))


QUARTERS = 4       # parts of the events by time, which arrive one after the other


def _quarters(spark, sf_dir):
    """The events of each quarter of their time, as a frame that Spark writes as it
    reads it: as many files as tasks."""
    ev = table(spark, sf_dir, "events")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return [ev]
    step = (hi - lo) / QUARTERS
    edges = [lo + step * k for k in range(QUARTERS)]
    return [ev.where(F.col("ts") >= F.lit(a)).where(F.lit(True) if b is None else F.col("ts") < F.lit(b))
            for a, b in zip(edges, [*edges[1:], None])]


def q_stream_daily_ohlcv(spark, sf_dir):
    out, ckpt = bs.scratch_paths(spark, "stream_daily_ohlcv")
    bs.run_available(bs.stream_daily_ohlcv(_tick_stream(spark, sf_dir), LATENESS), out, ckpt)
    return common.round_doubles(spark.read.parquet(out))


def q_incremental_features(spark, sf_dir):
    """Every quarter of the events is one run of the stream, on the same checkpoint."""
    base, ckpt = bs.scratch_paths(spark, "incremental_features")
    bars_path, feat_path = f"{base}/bars", f"{base}/features"
    for k, part in enumerate(_quarters(spark, sf_dir)):
        part.write.parquet(f"{base}/events/part={k}")
        ticks = _ticks(spark.readStream.schema(part.schema).parquet(f"{base}/events/part=*"), part.schema["ts"].dataType)
        bs.run_incremental_features(bs.stream_daily_ohlcv(ticks, LATENESS), bars_path, feat_path, ckpt,
                                    common.calendar())
    ft = spark.read.parquet(feat_path)
    cols = [c for c in feature_table(spark.read.parquet(bars_path), common.calendar()).columns]
    return common.round_doubles(ft.select(*cols))


QUERIES = {
    "stream_daily_ohlcv": q_stream_daily_ohlcv,
    "incremental_features": q_incremental_features,
}

STREAM_BARS_CTE = """ev AS (
  SELECT event_type AS symbol, ts, CAST(event_id AS BIGINT) AS seq,
         CAST(value AS DOUBLE) AS px FROM events),
bars AS (
  SELECT symbol, CAST(ts AS DATE) AS "Date",
         arg_min(px, struct_pack(t := ts, s := seq)) AS "Open",
         max(px) AS "High", min(px) AS "Low",
         arg_max(px, struct_pack(t := ts, s := seq)) AS "Close",
         CAST(count(*) AS DOUBLE) AS "Volume"
  FROM ev
  WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
        <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
  GROUP BY symbol, CAST(ts AS DATE))"""

SQL = {
    "stream_daily_ohlcv": f"""WITH {STREAM_BARS_CTE}
SELECT symbol, "Date", {O.r('"Open"')} AS "Open", {O.r('"High"')} AS "High",
       {O.r('"Low"')} AS "Low", {O.r('"Close"')} AS "Close", {O.r('"Volume"')} AS "Volume"
FROM bars""",
    "incremental_features": f"""WITH {O.features_cte(True, STREAM_BARS_CTE)}
SELECT
  """ + O.select_rounded({n: O.q(n) for n in O.feature_table_exprs()}, O.feature_doubles()) +
    "\nFROM features",
}
