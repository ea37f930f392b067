"""The training window: the last rows of each series up to an as-of day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def train_window(df: DataFrame, n: int, order: str = "Date", key: str = "symbol",
                 as_of: dt.date | None = None) -> DataFrame:
    """Last n rows of each series by date, none later than ``as_of``.

    Ranked in ascending order against the series length, so it reuses the
    (key, date) sort of the feature windows instead of adding a descending one.
    """
    if as_of is not None:
        df = df.where(F.col(order) <= F.lit(as_of))
    w = Window.partitionBy(key).orderBy(order)
    return (df.withColumn("_r", F.row_number().over(w))
              .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
              .where(F.col("_r") > F.col("_n") - F.lit(n)).drop("_r", "_n"))
