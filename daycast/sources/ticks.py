"""Map the driver tables onto the tick frame (symbol, ts, seq, OHLCV).

Only the columns a mapping needs are selected, so the Parquet scan reads
exactly those (column pruning reaches ``ReadSchema``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _price_ticks(df: DataFrame, symbol, ts, seq, price, volume) -> DataFrame:
    price = price.cast("double")
    return df.select(
        symbol.alias("symbol"),
        ts.alias("ts"),
        seq.cast("long").alias("seq"),
        price.alias("Open"), price.alias("High"),
        price.alias("Low"), price.alias("Close"),
        volume.cast("double").alias("Volume"),
    )


def orders_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main tick source: one order = one trade of its priority class."""
    o = table(spark, sf_dir, "orders")
    return _price_ticks(o, F.col("o_orderpriority"), F.col("o_orderdate"),
                        F.col("o_orderkey"), F.col("o_totalprice"), F.lit(1.0))


def events_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday source (30 days, microsecond timestamps)."""
    e = table(spark, sf_dir, "events")
    return _price_ticks(e, F.col("event_type"), F.col("ts"), F.col("event_id"),
                        F.col("value"), F.lit(1.0))


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume source: unit price per line, quantity as volume.

    Keys repeat, so there is no order inside a day: only the
    order-free aggregates (max, min, sum) are meaningful on it.
    """
    li = table(spark, sf_dir, "lineitem")
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    return _price_ticks(li, F.col("l_returnflag"), F.col("l_shipdate"),
                        F.lit(None).cast("long"), price, F.col("l_quantity"))
