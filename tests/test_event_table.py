"""Event tables against brute force, with any number of slices."""
import datetime as dt

import numpy as np
import pytest

from daycast.functions import calendar as cal
from daycast.operators import event_table as et
from daycast.plans import common
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)


def frames(spark, rows, events):
    day = lambda k: None if k is None else DAY + dt.timedelta(days=int(k))
    return (spark.createDataFrame([(s, day(k), n) for n, (s, k) in enumerate(rows)], "symbol string, Date date, n int"),
            spark.createDataFrame([(s, day(k), "x") for s, k in events], "symbol string, event_date date, n string"))


def brute(rows, events, by, reach):
    out = []
    for n, (s, k) in enumerate(rows):
        own = sorted(e for t, e in events if e is not None and (t == s or not by))
        before = [e for e in own if k is not None and e <= k]
        after = [e for e in own if k is not None and e >= k]
        out.append((n, int(k is not None and k in own), k - before[-1] if before else 0, after[0] - k if after else 0,
                    len(before), int(any(k - e <= reach for e in before))))
    return out


def run(rows, events, by, reach, slices):
    found = et.as_of_events(rows, events, by=by, slices=slices)
    found = et.post_events(found, events, reach, by=by)
    cols = et.event_columns()
    return sorted(tuple(r) for r in found.select("n", *[c.alias(k) for k, c in cols.items()], "post_event_flag").collect())


@pytest.mark.parametrize("by", [[], ["symbol"]])
@pytest.mark.parametrize("slices", [1, 7, None])
def test_matches_brute_force(spark, by, slices):
    rng = np.random.default_rng(len(by) * 10 + (slices or 0))
    rows = [("abc"[i], int(k)) for i, k in zip(rng.integers(0, 3, 150), rng.integers(-40, 400, 150))]
    rows += [("z", 5), (None, 7), ("a", None)]
    events = [("abd"[i], int(k)) for i, k in zip(rng.integers(0, 3, 60), rng.integers(0, 380, 60))]
    events += [events[0], (None, 3), ("a", None)]
    for reach in (0, 4, 30):
        assert run(*frames(spark, rows, events), by, reach, slices) == brute(rows, events, by, reach)


def test_without_events_or_rows(spark):
    rows, events = frames(spark, [("a", 1)], [("a", 1)])
    assert run(rows, events.limit(0), ["symbol"], 3, 4) == [(0, 0, 0, 0, 0, 0)]
    assert run(rows.limit(0), events, [], 3, 4) == []


def test_agrees_with_the_literal_calendar(spark):
    bars = common.bars(spark, "/root/testdata/sf0.001").select("symbol", "Date")
    dates = common.calendar()
    events = spark.createDataFrame([(d,) for d in dates], "event_date date")
    found = et.post_events(et.as_of_events(bars, events, slices=3), events, cal.POST_EVENT_DAYS)
    arr, d = cal.calendar_array(dates), F.col("Date")
    cols = et.event_columns()
    assert found.where((cols["event_flag"] != cal.event_flag(d, arr)) | (cols["days_since_event"] != cal.days_since_event(d, arr))
                       | (cols["days_until_event"] != cal.days_until_event(d, arr))
                       | (cols["event_cycle"] != cal.event_cycle(d, arr))
                       | (F.col("post_event_flag") != cal.post_event_flag(d, arr))).count() == 0
    assert found.count() == bars.count()


def test_no_nested_loops(spark):
    rows, events = frames(spark, [("a", 1)], [("a", 1)])
    for by in ([], ["symbol"]):
        plan = et.post_events(et.as_of_events(rows, events, by=by, slices=2), events, 3, by=by) \
            ._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
