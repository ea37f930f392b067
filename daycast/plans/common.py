"""Shared pieces of the registered queries: inputs, rounding, parameters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from daycast.functions.calendar import testdata_calendar
from daycast.operators.bars import daily_ohlcv
from daycast.session import checkpoint_dir
from daycast.sources.ticks import orders_ticks

# Decimal places doubles are rounded to in query outputs, so the Spark
# result and the SQL oracle compare equal despite summation order.
DIGITS = 4

# Fixed query parameters on the driver tables (orders end 2001-08-01).
AS_OF = dt.date(2001, 8, 1)
CV_FOLDS = 5
FORECAST_HORIZON = 30          # run horizon of the derived forecast log
TRAIN_WINDOW = 1095            # rows of history a forecast fits on
AR_LAGS = 3                    # lags of Close in the autoregressive forecast
STORE_MODELS = ("naive", "ma7")


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (output presentation only); one
    ``selectExpr`` call, so wide tables cost no per-column round trips."""
    exprs = [f"round(`{f.name}`, {digits}) AS `{f.name}`"
             if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
             for f in df.schema.fields]
    return df.selectExpr(*exprs)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the main tick source (orders by priority class)."""
    return daily_ohlcv(orders_ticks(spark, sf_dir))


def materialize(df: DataFrame) -> DataFrame:
    """Compute a bar-level intermediate once when it feeds several branches
    of a plan (the DataFrame API does not share subplans): a reliable
    checkpoint in the shared ``spark.checkpoint.dir``, never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars scanned and aggregated once for plans that use them twice."""
    return materialize(bars(spark, sf_dir))


def calendar() -> list[dt.date]:
    return testdata_calendar()
