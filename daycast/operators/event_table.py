"""Event features against a table of events of any size.

``functions/calendar.py`` inlines a handful of dates; here the events are a table, with
a key of their own if wanted (events per series).

* ``as_of_events`` — last event on or before a day, next one on or after it, and the
  number so far, without pairing rows with events: days and events are united, range-
  partitioned by (key, day) and stored in slices; inside a slice the last event is
  carried forward and the next one backward; the ends of the slices, one row each, are
  scanned once, and what they carry is added. No task holds more than a slice.
* ``post_events`` — whether some event lies 0..n days back: an interval semi-join by
  bins of n + 1 days. An event of a day's own bin is in reach if it is not later than
  the day, one of the bin before if it is not too early, so the first event of the one
  and the last event of the other decide, and a bin needs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daycast.session import stored

SLICE_ROWS = 1_000_000      # days and events of a slice, about


def _days(df: DataFrame, day: str, by: list[str]) -> DataFrame:
    return df.select(*by, F.to_date(day).alias("_day")).where("_day IS NOT NULL")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys, null equal to null."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}_r"])
    return out


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    right = right.select(*[F.col(k).alias(f"_{k}_r") for k in keys],
                         *[c for c in right.columns if c not in keys])
    return left.join(right, _same(left, right, keys), how).drop(*[f"_{k}_r" for k in keys])


def as_of_events(rows: DataFrame, events: DataFrame, day: str = "Date", event_day: str = "event_date",
                 by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """rows + ``last_event``, ``next_event`` (dates, null without one), ``events_so_far``.

    ``by``: columns of both tables that an event must share with a row. A row without a
    day has no events.
    """
    by = list(by or [])
    both = _days(rows, day, by).withColumns({"_row": F.lit(1), "_event": F.lit(0)}).unionByName(
        _days(events, event_day, by).withColumns({"_row": F.lit(0), "_event": F.lit(1)}))
    # a row per (key, day); how many events a day has counts
    days = both.groupBy(*by, "_day").agg(F.max("_row").alias("_row"), F.sum("_event").alias("_events"))
    if slices is None:
        days = stored(days, "event-days")
        slices = max(1, -(-days.count() // SLICE_ROWS))
    order = [*by, "_day"]
    held = stored(days.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()), "event-slices")
    event = F.when(F.col("_events") > 0, F.col("_day"))
    forward = Window.partitionBy("_slice", *by).orderBy("_day")
    backward = Window.partitionBy("_slice", *by).orderBy(F.desc("_day"))
    inside = held.withColumns({"last_event": F.max(event).over(forward), "events_so_far": F.sum("_events").over(forward),
                               "next_event": F.min(event).over(backward)})
    ends = held.groupBy("_slice", *by).agg(F.max(event).alias("_l"), F.min(event).alias("_f"), F.sum("_events").alias("_n"))
    # the scan of the slice ends: one row per slice and key
    key = [*by] or [F.lit(0)]
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*key).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_slice", *by, F.max("_l").over(earlier).alias("_l"), F.sum("_n").over(earlier).alias("_n"),
                          F.min("_f").over(later).alias("_f"))
    out = _joined(inside.where("_row = 1"), carried, ["_slice", *by])
    found = out.select(*by, F.col("_day"), F.coalesce("last_event", "_l").alias("last_event"),
                       F.coalesce("next_event", "_f").alias("next_event"),
                       (F.col("events_so_far") + F.coalesce("_n", F.lit(0))).alias("events_so_far"))
    left = rows.withColumn("_day", F.to_date(day))
    return _joined(left, found, [*by, "_day"]).drop("_day") \
        .withColumn("events_so_far", F.coalesce("events_so_far", F.lit(0)))


def event_columns(day: str = "Date") -> dict[str, Column]:
    """The calendar features from ``as_of_events``' columns (rules of functions/calendar.py)."""
    d = F.to_date(day)
    return {"event_flag": F.coalesce((F.col("last_event") == d).cast("int"), F.lit(0)),
            "days_since_event": F.coalesce(F.datediff(d, "last_event"), F.lit(0)).cast("long"),
            "days_until_event": F.coalesce(F.datediff("next_event", d), F.lit(0)).cast("long"),
            "event_cycle": F.col("events_so_far").cast("long")}


def post_events(rows: DataFrame, events: DataFrame, days: int, day: str = "Date", event_day: str = "event_date",
                by: list[str] | None = None, out: str = "post_event_flag") -> DataFrame:
    """rows + a flag: 1 when an event lies 0..``days`` days before the row's day."""
    by = list(by or [])
    width = days + 1

    def bin_(c: str) -> Column:
        return F.floor(F.unix_date(F.to_date(c)) / F.lit(width))
    one = _days(events, event_day, by).withColumn("_bin", bin_("_day"))
    bins = (one.groupBy(*by, "_bin").agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi")))
    reach = F.array(
        F.struct(F.col("_bin").alias("_bin"), F.col("_lo").alias("_own"), F.lit(None).cast("date").alias("_before")),
        F.struct((F.col("_bin") + 1).alias("_bin"), F.lit(None).cast("date").alias("_own"), F.col("_hi").alias("_before")))
    bins = (bins.select(*by, F.inline(reach)).groupBy(*by, "_bin")
            .agg(F.min("_own").alias("_own"), F.max("_before").alias("_before")))
    d = F.to_date(day)
    hit = (F.col("_own") <= d) | (F.col("_before") >= F.date_sub(d, days))
    return (_joined(rows.withColumn("_bin", bin_(day)), bins, [*by, "_bin"])
            .withColumn(out, F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0).cast("long"))
            .drop("_bin", "_own", "_before"))
