"""Forecast store rules on hand-made runs: duplicates, force, merge order."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from daycast.operators import manifest as mf
from daycast.operators import store as st
from daycast.sources.schemas import CURRENT, RUNS

D = dt.date


def runs(spark, rows):
    return spark.createDataFrame(rows, RUNS)


def cur(spark, rows):
    return spark.createDataFrame(rows, CURRENT)


def test_duplicate_run_raises_without_force(spark):
    idx = runs(spark, [("S", "linear", D(2024, 1, 1), 7, 7, {"window_size": "1095"})])
    dup = runs(spark, [("S", "linear", D(2024, 1, 1), 7, 9, None)])
    with pytest.raises(FileExistsError):
        st.upsert_run(idx, dup)
    out = st.upsert_run(idx, dup, force=True).collect()
    assert len(out) == 1 and out[0]["rows_count"] == 9


def test_new_run_is_appended(spark):
    idx = runs(spark, [("S", "linear", D(2024, 1, 1), 7, 7, None)])
    new = runs(spark, [("S", "linear", D(2024, 1, 2), 7, 7, None)])
    assert st.upsert_run(idx, new).count() == 2


def test_merge_rules(spark):
    run_date = D(2024, 1, 10)
    current = cur(spark, [
        ("S", "m", D(2024, 1, 9), 1.0, D(2024, 1, 1)),    # before run date: kept
        ("S", "m", D(2024, 1, 10), 2.0, D(2024, 1, 1)),   # on run date: not in new → kept
        ("S", "m", D(2024, 1, 11), 3.0, D(2024, 1, 1)),   # after: replaced by newer run
        ("S", "m", D(2024, 1, 30), 4.0, D(2024, 1, 1)),   # after, not in new: kept
        ("T", "m", D(2024, 1, 11), 5.0, D(2024, 1, 1)),   # other series untouched
    ])
    incoming = spark.createDataFrame(
        [("S", D(2024, 1, 9), 9.0), ("S", D(2024, 1, 10), 9.5), ("S", D(2024, 1, 11), 10.0),
         ("S", D(2024, 1, 12), 11.0)],
        "symbol string, target_date date, prediction double")
    merged = st.merge_current(current, incoming, run_date=run_date, model="m")
    got = {(r["symbol"], r["target_date"]): (r["prediction"], r["run_date"])
           for r in merged.collect()}
    assert got[("S", D(2024, 1, 9))] == (1.0, D(2024, 1, 1))     # past rows of new run dropped
    assert got[("S", D(2024, 1, 10))] == (2.0, D(2024, 1, 1))
    assert got[("S", D(2024, 1, 11))] == (10.0, run_date)         # newest wins
    assert got[("S", D(2024, 1, 12))] == (11.0, run_date)
    assert got[("S", D(2024, 1, 30))] == (4.0, D(2024, 1, 1))
    assert got[("T", D(2024, 1, 11))] == (5.0, D(2024, 1, 1))
    assert len(got) == 6
    again = st.merge_current(merged, incoming, run_date=run_date, model="m")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_latest_per_target_and_needs_forecast(spark):
    log = cur(spark, [("S", "m", D(2024, 1, 11), 1.0, D(2024, 1, 1)),
                      ("S", "m", D(2024, 1, 11), 2.0, D(2024, 1, 5)),
                      ("S", "n", D(2024, 1, 11), 3.0, D(2024, 1, 10))])
    latest = st.latest_per_target(log)
    assert {r["model"]: r["prediction"] for r in latest.collect()} == {"m": 2.0, "n": 3.0}
    due = st.needs_forecast(log, latest, D(2024, 1, 10))
    assert {r["model"]: r["needs_forecast"] for r in due.collect()} == {"m": True, "n": False}


def test_versioned_store_roundtrip(spark, tmp_dir):
    base = f"{tmp_dir}/store"
    assert st.scan_runs(spark, base).count() == 0
    fc = spark.createDataFrame(
        [("S", "m", D(2024, 1, 1), D(2024, 1, 2) + dt.timedelta(days=i), float(i)) for i in range(5)],
        "symbol string, model string, run_date date, target_date date, prediction double")
    st.save_run(spark, base, fc, horizon=5, params={"window_size": 1095})
    assert st.scan_runs(spark, base).count() == 1
    assert st.scan_current(spark, base, "m").count() == 5
    with pytest.raises(FileExistsError):
        st.save_run(spark, base, fc, horizon=5)
    two = st.save_run(spark, base, fc.withColumn("prediction", F.lit(7.0)), 5, force=True)
    assert two.number == 2
    assert {r["prediction"] for r in st.scan_current(spark, base).collect()} == {7.0}
    other = fc.withColumn("model", F.lit("k")).withColumn("run_date", F.lit(D(2024, 1, 2)))
    three = st.save_run(spark, base, other, 5)          # another model: m is not rewritten
    assert three.partitions["current/m/2024-01"] == two.partitions["current/m/2024-01"]
    assert st.scan_current(spark, base).count() == 5 + 4   # k keeps targets after its run date
    assert st.scan_current(spark, base, "k").count() == 4
    assert st.scan_runs(spark, base).count() == 2


def frame(spark, n=5, model="m", run=D(2024, 1, 1)):
    return spark.createDataFrame(
        [("S", model, run, run + dt.timedelta(days=i + 1), float(i)) for i in range(n)],
        "symbol string, model string, run_date date, target_date date, prediction double")


def test_a_run_rewrites_the_months_it_touches_only(spark, tmp_dir):
    base = f"{tmp_dir}/store"
    log = []
    for month in range(1, 7):                           # 40 days each: two or three months
        run = D(2024, month, 1)
        both = frame(spark, 40, "m", run).unionByName(frame(spark, 40, "k", run))
        version = st.save_run(spark, base, both, 40)
        log += [(m, D(2024, month, 1), run + dt.timedelta(days=i + 1), float(i)) for m in "mk" for i in range(40)]
    assert version.number == 6
    before = mf.newest(spark, base).partitions
    after = st.save_run(spark, base, frame(spark, 40, "k", D(2024, 6, 15)), 40).partitions
    changed = {k for k in after if after[k] != before.get(k)}
    assert changed == {"current/k/2024-06", "current/k/2024-07", "runs/2024-06"}
    log += [("k", D(2024, 6, 15), D(2024, 6, 15) + dt.timedelta(days=i + 1), float(i)) for i in range(40)]
    want = {}
    for model, run, day, p in sorted(log, key=lambda r: r[1]):     # the newest run wins
        want[model, day] = (p, run)
    got = {(r.model, r.target_date): (r.prediction, r.run_date) for r in st.scan_current(spark, base).collect()}
    assert got == want
    assert st.scan_runs(spark, base).count() == 13


def test_of_two_writers_one_is_refused_by_name(spark, tmp_dir, monkeypatch):
    import os
    base = f"{tmp_dir}/store"
    st.save_run(spark, base, frame(spark), 5)
    plain, late = mf.newest, []

    def overtaken(*a):
        """The other writer commits right after this one read the table."""
        held = plain(*a)
        if not late:
            late.append(1)
            st.save_run(spark, base, frame(spark, run=D(2024, 1, 2)), 5)
        return held
    monkeypatch.setattr(mf, "newest", overtaken)
    with pytest.raises(mf.ConcurrentCommitError, match="version 2 of"):
        st.save_run(spark, base, frame(spark, run=D(2024, 1, 3)), 5)
    monkeypatch.setattr(mf, "newest", plain)
    assert {r.run_date for r in st.scan_runs(spark, base).collect()} == {D(2024, 1, 1), D(2024, 1, 2)}
    assert len(os.listdir(f"{base}/data")) == 2          # the refused one left nothing
    assert st.save_run(spark, base, frame(spark, run=D(2024, 1, 3)), 5).number == 3
    late.clear()
    t = f"{tmp_dir}/t"
    st.sink_atomic(spark.range(1), t)
    held = mf.newest(spark, t)
    st.sink_atomic(spark.range(2), t)
    with pytest.raises(mf.ConcurrentCommitError):
        mf.commit(spark, t, held, {"table": "data/none"})
    assert st.scan_versioned(spark, t, "id long").count() == 2


def test_a_torn_manifest_is_passed_over(spark, tmp_dir, monkeypatch):
    base = f"{tmp_dir}/store"
    st.save_run(spark, base, frame(spark), 5)
    with open(f"{base}/_manifest/00000002.json", "w") as f:
        f.write('{"partitions": {"curr')                 # a crash in the middle of the commit
    with pytest.raises(mf.ConcurrentCommitError, match="is being committed"):
        st.scan_runs(spark, base)
    monkeypatch.setattr(mf, "SECONDS_TO_COMMIT", -1)
    assert st.scan_runs(spark, base).count() == 1
    assert st.save_run(spark, base, frame(spark, run=D(2024, 1, 2)), 5).number == 3
    assert st.scan_runs(spark, base).count() == 2


def test_old_versions_and_their_folders_go(spark, tmp_dir):
    import os
    t = f"{tmp_dir}/t"
    for n in range(1, 6):
        path = st.sink_atomic(spark.range(n), t, keep=2)
    assert sorted(os.listdir(f"{t}/_manifest")) [-2:] == ["00000004.json", "00000005.json"]
    assert len(os.listdir(f"{t}/data")) == 2
    assert st.latest_version(spark, t) == path and st.scan_versioned(spark, t, "id long").count() == 5
    assert st.latest_version(spark, f"{tmp_dir}/none") is None


def test_the_forecast_is_computed_once_and_not_for_a_refused_duplicate(spark, tmp_dir):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    two = frame(spark).unionByName(frame(spark, model="k"))
    slow = two.mapInArrow(counted, two.schema)
    st.save_run(spark, f"{tmp_dir}/s", slow, 5, keys=[("S", "m", D(2024, 1, 1)), ("S", "k", D(2024, 1, 1))])
    assert seen.value == 10
    with pytest.raises(FileExistsError):
        st.save_run(spark, f"{tmp_dir}/s", slow, 5, keys=[("S", "m", D(2024, 1, 1))])
    assert seen.value == 10


def test_payloads_into_the_store(spark, tmp_dir):
    from daycast.sources.schemas import FORECAST_PAYLOAD
    row = lambda d, p: (d, p)
    one = ("S", "m", "2024-01-01", 2, {"a": "1"}, None, [row("2024-01-02", 1.0), row("2024-01-03", 2.0)])
    df = lambda *r: spark.createDataFrame(list(r), FORECAST_PAYLOAD)
    base = f"{tmp_dir}/s"
    st.save_payloads(spark, base, df(one))
    run = st.scan_runs(spark, base).first()
    assert (run.symbol, run.horizon, run.rows_count, run.params) == ("S", 2, 2, {"a": "1"})
    with pytest.raises(FileExistsError):
        st.save_payloads(spark, base, df(one))
    forced = (*one[:5], True, [row("2024-01-02", 9.0)])
    st.save_payloads(spark, base, df(forced))
    assert {r.prediction for r in st.scan_current(spark, base).collect()} >= {9.0}
    with pytest.raises(Exception, match="payload without rows: S m"):
        st.explode_payloads(df((*one[:6], []))).collect()


def test_rows_to_frame_takes_whole_numbers(spark):
    got = st.rows_to_frame(spark, [{"target_date": "2024-01-02", "prediction": 5},
                                   {"target_date": D(2024, 1, 3), "prediction": 1.5}]).collect()
    assert [(r.target_date, r.prediction) for r in got] == [(D(2024, 1, 2), 5.0), (D(2024, 1, 3), 1.5)]
    for bad in ([], [{"target_date": "2024-01-02"}], [{"target_date": "2024-01-02", "prediction": "x"}]):
        with pytest.raises(ValueError):
            st.rows_to_frame(spark, bad)


def test_absent_tables_are_stale(spark):
    series = spark.createDataFrame([("A",), ("B",)], "symbol string")
    assert [r.stale for r in st.is_stale(None, D(2024, 1, 2), series=series).collect()] == [True, True]
    bars = spark.createDataFrame([("A", D(2024, 1, 1))], "symbol string, Date date")
    assert {r.symbol: r.stale for r in st.is_stale(bars, D(2024, 1, 2), series=series).collect()} == \
        {"A": False, "B": True}
    empty = bars.limit(0)
    assert {r.stale for r in st.is_stale(empty, D(2024, 1, 2), series=series).collect()} == {True}
    with pytest.raises(ValueError):
        st.is_stale(None, D(2024, 1, 2))


def test_text_forms(spark):
    df = spark.createDataFrame([(D(2024, 2, 9), 7, 2.5, {"b": "1", "a": "2"}, {"b": "9"}),
                                (None, None, None, None, None)],
                               "d date, n int, x double, p map<string,string>, q map<string,string>")
    out = df.select(st.day_text(F.col("d")).alias("d"), st.number_text(F.col("n")).alias("n"),
                    st.number_text(F.col("x"), 2).alias("x"),
                    st.params_json(st.merge_params(F.col("p"), F.col("q"))).alias("j")).collect()
    assert tuple(out[0]) == ("2024-02-09", "7", "2.50", '{"a":"2","b":"9"}')
    assert out[1].d is None and out[1].n is None and out[1].j == "{}"


def test_models_side_by_side_and_over_history(spark):
    from daycast.operators import evaluation as ev
    current = frame(spark, 2).unionByName(frame(spark, 1, "k"))
    bars = spark.createDataFrame([("S", D(2024, 1, 1), 9.0)], "symbol string, Date date, Close double")
    wide = {r.target_date: r for r in ev.compare_models(current).collect()}
    assert (wide[D(2024, 1, 2)].k, wide[D(2024, 1, 2)].m, wide[D(2024, 1, 3)].k) == (0.0, 0.0, None)
    assert ev.compare_models(current, ["m", "other"]).columns == ["symbol", "target_date", "m", "other"]
    every = sorted((r.date, r.series, r.value) for r in ev.overlay_history_forecast(bars, current).collect())
    assert every == [(D(2024, 1, 1), "actual", 9.0), (D(2024, 1, 2), "k", 0.0), (D(2024, 1, 2), "m", 0.0),
                     (D(2024, 1, 3), "m", 1.0)]
    some = ev.overlay_history_forecast(bars, current, ["k"], since=D(2024, 1, 2)).collect()
    assert [(r.series, r.value) for r in some] == [("k", 0.0)]
