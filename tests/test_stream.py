"""Stream bars equal batch bars on closed days."""
from pyspark.sql import functions as F

from daycast.operators.bars import daily_ohlcv
from daycast.plans import streams_q
from daycast.sources.ticks import events_ticks
from conftest import SMALL


def test_stream_equals_batch_on_closed_days(spark):
    stream = streams_q.q_stream_daily_ohlcv(spark, SMALL)
    batch = daily_ohlcv(events_ticks(spark, SMALL))
    closed = stream.select("symbol", "Date")
    b = batch.join(closed, ["symbol", "Date"], "left_semi")
    cols = ["symbol", "Date", "Open", "High", "Low", "Close", "Volume"]
    b = b.select(*[F.round(c, 4).alias(c) if c not in ("symbol", "Date") else c for c in cols])
    s = stream.select(*cols)
    assert stream.count() > 0
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
    last = batch.agg(F.max("Date")).first()[0]
    assert stream.where(F.col("Date") >= last).count() == 0   # the open day is held back


def test_foreach_batch_handler_is_idempotent(spark, tmp_dir):
    from daycast.plans import common
    from daycast.streaming.bars_stream import incremental_features
    bars = common.bars(spark, SMALL)
    handle = incremental_features(f"{tmp_dir}/bars", f"{tmp_dir}/features", common.calendar())
    handle(bars, 7)
    handle(bars, 7)                       # a retried epoch replaces its first attempt
    assert spark.read.parquet(f"{tmp_dir}/bars").count() == bars.count()
    ft = spark.read.parquet(f"{tmp_dir}/features")
    assert ft.count() == bars.count() and "symbol" in ft.columns


def test_incremental_equals_full_recompute(spark, tmp_dir):
    import datetime as dt
    from daycast.operators.features import feature_table
    from daycast.plans import common
    from daycast.streaming.bars_stream import incremental_features
    bars = common.bars(spark, SMALL)
    cut = dt.date(1999, 6, 1)
    handle = incremental_features(f"{tmp_dir}/b", f"{tmp_dir}/f", common.calendar())
    handle(bars.where(F.col("Date") < cut), 0)
    handle(bars.where(F.col("Date") >= cut), 1)
    full = feature_table(bars, common.calendar())
    inc = spark.read.parquet(f"{tmp_dir}/f").select(*full.columns)
    r = common.round_doubles
    assert inc.count() == full.count()
    assert r(inc).exceptAll(r(full)).count() == 0


def test_late_ticks_within_lateness_are_kept(spark, tmp_dir):
    import datetime as dt
    from daycast.sources.schemas import TICKS
    from daycast.streaming import bars_stream as bs
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(f.name, T.TimestampType() if f.name == "ts"
                                         else f.dataType) for f in TICKS.fields])
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"

    def tick(day, hour, seq, px):
        return ("A", dt.datetime(2024, 1, day, hour), seq, px, px, px, px, 1.0)

    def run():
        stream = bs.read_tick_stream(spark, src, schema)
        bs.run_available(bs.stream_daily_ohlcv(stream, "1 day"), out, ck)

    spark.createDataFrame([tick(1, 9, 1, 10.0), tick(2, 9, 2, 20.0), tick(4, 9, 3, 40.0)],
                          schema).write.mode("append").parquet(src)
    run()                                   # watermark: Jan 4 09:00 - 1 day = Jan 3 09:00
    spark.createDataFrame([tick(3, 10, 4, 30.0),     # late, within lateness: kept
                           tick(1, 12, 5, 99.0),     # its day already closed: dropped
                           tick(6, 9, 6, 60.0)],     # moves the watermark past Jan 4
                          schema).write.mode("append").parquet(src)
    run()
    got = {r["Date"]: r["Close"] for r in spark.read.parquet(out).collect()}
    assert got[dt.date(2024, 1, 1)] == 10.0            # the too-late tick changed nothing
    assert got[dt.date(2024, 1, 3)] == 30.0
    assert dt.date(2024, 1, 4) in got and dt.date(2024, 1, 6) not in got   # Jan 6 still open


def test_every_batch_after_the_first_reads_a_bounded_state(spark, tmp_dir, monkeypatch):
    import datetime as dt
    from daycast.plans import common
    from daycast.streaming import bars_stream as bs
    bars = common.bars(spark, SMALL).cache()
    calls = []
    plain = bs.incremental_feature_rows
    monkeypatch.setattr(bs, "incremental_feature_rows",
                        lambda state, *a, **k: calls.append(state) or plain(state, *a, **k))
    handle = bs.incremental_features(f"{tmp_dir}/b", f"{tmp_dir}/f", common.calendar())
    edges = [dt.date(1900, 1, 1), dt.date(1994, 1, 1), dt.date(1997, 1, 1), dt.date(2000, 1, 1), dt.date(2100, 1, 1)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        handle(bars.where((F.col("Date") >= F.lit(a)) & (F.col("Date") < F.lit(b))), k)
    assert calls[0] is None and all(c is not None for c in calls[1:])
    state = bs.read_state(spark, f"{tmp_dir}/f_state")
    assert state.agg(F.max(F.size("tail"))).first()[0] <= bs.LOOKBACK
    assert state.agg(F.sum("n")).first()[0] == bars.count()
    assert state.count() == bars.select("symbol").distinct().count()


def test_what_a_batch_writes_follows_the_touched_symbols(spark, tmp_dir):
    import datetime as dt
    import os
    from daycast.plans import common
    from daycast.streaming import bars_stream as bs
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    schema = "symbol string, Date date, Open double, High double, Low double, Close double, Volume double"

    def bars(symbols, days):
        return spark.createDataFrame([(s, day(k), *[float(k + 1)] * 5) for s in symbols for k in days], schema)

    def size(epoch):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{tmp_dir}/f_state/epoch={epoch}")
                   for f in names if f.endswith(".parquet"))
    every = [f"s{k}" for k in range(60)]
    handle = bs.incremental_features(f"{tmp_dir}/b", f"{tmp_dir}/f", common.calendar(), buckets=1000)
    handle(bars(every, range(20)), 0)
    handle(bars(["s7", "s8"], [20]), 1)
    handle(bars(["s7"], [21]), 2)
    handle(bars(["s7"], [21]), 2)                         # a replay replaces its first attempt
    assert size(1) < size(0) / 15 and size(2) < size(0) / 30
    held = {r.symbol: r.n for r in bs.read_state(spark, f"{tmp_dir}/f_state").collect()}
    assert held == {s: {"s7": 22, "s8": 21}.get(s, 20) for s in every}
    ft = spark.read.parquet(f"{tmp_dir}/f")
    assert {r.Datetime: r.trend for r in ft.where("symbol = 's7'").collect()} == {day(k): float(k) for k in range(22)}
    assert ft.count() == 60 * 20 + 3


def test_the_registered_query_runs_in_several_batches(spark, monkeypatch):
    from daycast.streaming import bars_stream as bs
    states = []
    plain = bs.incremental_feature_rows
    monkeypatch.setattr(bs, "incremental_feature_rows",
                        lambda state, *a, **k: states.append(state) or plain(state, *a, **k))
    assert streams_q.q_incremental_features(spark, SMALL).count() > 0
    assert len(states) >= 3 and sum(s is not None for s in states) >= 2
