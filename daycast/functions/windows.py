"""Row-window column expressions over one series ordered by date.

All frames share ``partitionBy(key).orderBy(date)``, so Catalyst plans a
single Window operator (one exchange on the key, one sort) for every
lag / rolling column of a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series_window(key: str = "symbol", order: str = "Date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def roll(w: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` rows up to and including the current one."""
    return w.rowsBetween(-(n - 1), Window.currentRow)


def lag_n(c: str, n: int, w: WindowSpec) -> Column:
    return F.lag(F.col(c), n).over(w)


def rolling_mean(c: str, n: int, w: WindowSpec) -> Column:
    """Mean of the last n values; null until n non-null values are present."""
    fw = roll(w, n)
    return F.when(F.count(F.col(c)).over(fw) == n, F.avg(F.col(c)).over(fw))


def rolling_std(c: str, n: int, w: WindowSpec) -> Column:
    """Sample standard deviation (ddof 1) of the last n values, null until full."""
    fw = roll(w, n)
    return F.when(F.count(F.col(c)).over(fw) == n, F.stddev_samp(F.col(c)).over(fw))


def period_return(c: str, n: int, w: WindowSpec) -> Column:
    """c / c[n rows back] - 1; a zero or missing base gives null (ANSI-safe)."""
    return F.try_divide(F.col(c), F.lag(F.col(c), n).over(w)) - F.lit(1.0)


def trend_index(w: WindowSpec) -> Column:
    """0-based position of the row inside its series."""
    return (F.row_number().over(w) - 1).cast("double")
