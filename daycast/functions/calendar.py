"""Event-calendar features as array higher-order functions.

The calendar is a short list of dates, carried as an ``ARRAY<DATE>``
literal: every feature is a per-row expression inside whole-stage codegen,
with no join and no Python. A calendar grows by one date every few years,
so its size is bounded by construction.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's event calendar starts on 2012-11-28 and
# repeats every 4 years on 28 November, 10 dates in all.
REFERENCE_FIRST_EVENT = dt.date(2012, 11, 28)
REFERENCE_EVENT_STEP_YEARS = 4
REFERENCE_EVENT_COUNT = 10
# Fixed value: the post-event flag covers 0..365 days after an event.
POST_EVENT_DAYS = 365

# Calendar used on the driver tables (orders span 1995-2001): the same
# 28 November rule, every 2 years from 1994, 6 dates.
TESTDATA_FIRST_EVENT = dt.date(1994, 11, 28)
TESTDATA_EVENT_STEP_YEARS = 2
TESTDATA_EVENT_COUNT = 6


def event_dates(first: dt.date, step_years: int, count: int) -> list[dt.date]:
    return [dt.date(first.year + step_years * i, first.month, first.day) for i in range(count)]


def reference_calendar() -> list[dt.date]:
    return event_dates(REFERENCE_FIRST_EVENT, REFERENCE_EVENT_STEP_YEARS, REFERENCE_EVENT_COUNT)


def testdata_calendar() -> list[dt.date]:
    return event_dates(TESTDATA_FIRST_EVENT, TESTDATA_EVENT_STEP_YEARS, TESTDATA_EVENT_COUNT)


def calendar_array(dates: list[dt.date]) -> Column:
    return F.array(*[F.lit(d) for d in sorted(dates)]).cast("array<date>")


def event_flag(d: Column, cal: Column) -> Column:
    """1 when the date is an event day, else 0."""
    return F.when(F.array_contains(cal, d), F.lit(1)).otherwise(F.lit(0))


def days_since_event(d: Column, cal: Column) -> Column:
    """Days since the latest event on or before d; 0 before the first."""
    last = F.array_max(F.filter(cal, lambda h: h <= d))
    return F.coalesce(F.datediff(d, last), F.lit(0)).cast("long")


def days_until_event(d: Column, cal: Column) -> Column:
    """Days until the next event on or after d; 0 after the last."""
    nxt = F.array_min(F.filter(cal, lambda h: h >= d))
    return F.coalesce(F.datediff(nxt, d), F.lit(0)).cast("long")


def event_cycle(d: Column, cal: Column) -> Column:
    """Number of events on or before d."""
    return F.size(F.filter(cal, lambda h: h <= d)).cast("long")


def post_event_flag(d: Column, cal: Column, days: int = POST_EVENT_DAYS) -> Column:
    """1 when some event lies 0..days before d (both ends included)."""
    hit = F.exists(cal, lambda h: F.datediff(d, h).between(0, days))
    return F.when(hit, F.lit(1)).otherwise(F.lit(0)).cast("long")
