"""Raw CSV path, epoch checks, scans and sinks."""
import pytest
from pyspark.sql import functions as F

from daycast.operators.bars import daily_ohlcv
from daycast.sources import io, raw
from daycast.sources.ticks import table
from conftest import SMALL


def minute_csv(spark, path, scale=1.0):
    ev = table(spark, SMALL, "events")
    df = ev.select((F.unix_seconds(F.col("ts").cast("timestamp")) * F.lit(scale)).cast("double")
                   .alias("Timestamp"),
                   F.col("value").alias("Open"), F.col("value").alias("High"),
                   F.col("value").alias("Low"), F.col("value").alias("Close"),
                   F.lit(1.0).alias("Volume"))
    df.write.mode("overwrite").option("header", True).csv(path)


def test_csv_to_processed_to_bars(spark, tmp_dir):
    minute_csv(spark, f"{tmp_dir}/raw")
    processed = io.csv_to_processed(spark, f"{tmp_dir}/raw", f"{tmp_dir}/processed")
    assert processed.columns == raw.PROCESSED_COLUMNS
    assert processed.count() == table(spark, SMALL, "events").count()
    b = daily_ohlcv(raw.processed_to_ticks(processed, "EVT"))
    assert b.count() == 30


def test_millisecond_epoch_is_rejected(spark, tmp_dir):
    minute_csv(spark, f"{tmp_dir}/raw_ms", scale=1000.0)
    df = raw.scan_ohlcv_csv(spark, f"{tmp_dir}/raw_ms")
    with pytest.raises(ValueError, match="milliseconds"):
        raw.check_epoch_unit(df)
    with pytest.raises(Exception, match="milliseconds"):      # in the one pass that reads the rows
        raw.preprocess(df).collect()


def test_missing_columns_named(spark):
    df = spark.range(1).withColumnRenamed("id", "Timestamp")
    with pytest.raises(ValueError, match="Open"):
        raw.select_required(raw.epoch_to_ts(df))


def test_feature_sink_prunes_partitions(spark, tmp_dir):
    from daycast.operators.features import feature_table
    from daycast.plans import common
    ft = feature_table(common.bars(spark, SMALL), common.calendar())
    io.sink_features(ft, f"{tmp_dir}/features")
    one = io.scan_features(spark, f"{tmp_dir}/features", ["symbol", "Datetime", "Close"],
                           symbols=["5-LOW"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and one.select("symbol").distinct().count() == 1


def write_csv(tmp_dir, name, text):
    path = f"{tmp_dir}/{name}.csv"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_columns_are_taken_by_name(spark, tmp_dir):
    path = write_csv(tmp_dir, "p", "Note,Timestamp,Close,Low,High,Open,Volume\nx,60,4,1,9,2,5\n")
    r = raw.scan_ohlcv_csv(spark, path).first()
    assert (r.Open, r.High, r.Low, r.Close, r.Volume, r.Timestamp, r.Note) == (2, 9, 1, 4, 5, 60, "x")


@pytest.mark.parametrize("missing", ["Volume", "Timestamp"])
def test_missing_csv_column_is_named(spark, tmp_dir, missing):
    names = [c for c in ("Timestamp", "Open", "High", "Low", "Close", "Volume") if c != missing]
    path = write_csv(tmp_dir, f"m{missing}", ",".join(names) + "\n1,2,3,4,5\n")
    with pytest.raises(ValueError, match=missing):
        raw.scan_ohlcv_csv(spark, path)


def test_malformed_rows_fail_or_are_set_aside(spark, tmp_dir):
    path = write_csv(tmp_dir, "bad", "Timestamp,Open,High,Low,Close,Volume\n60,1,2,3,4,5\nnoon,1,2,3,4,5\n")
    with pytest.raises(Exception):
        raw.preprocess(raw.scan_ohlcv_csv(spark, path)).collect()
    good, bad = raw.scan_ohlcv_csv(spark, path, rejects=True)
    assert raw.preprocess(good).count() == 1
    assert [r[raw.CORRUPT] for r in bad.collect()] == ["noon,1,2,3,4,5"]
    assert good.count() == 1 and bad.count() == 1 and bad.select(raw.CORRUPT).count() == 1
    assert [r.Close for r in good.select("Close").collect()] == [4.0]
    good.write.parquet(f"{tmp_dir}/good")
    bad.write.parquet(f"{tmp_dir}/bad")
    assert spark.read.parquet(f"{tmp_dir}/good").count() == spark.read.parquet(f"{tmp_dir}/bad").count() == 1


def test_rejects_are_counted_in_the_same_pass(spark, tmp_dir):
    from pyspark.sql import Observation
    head = "Close,Timestamp,Open,High,Low,note,Volume"
    for name, body in (("a", ["1,60,1,1,1,x,1", "2,oops,1,1,1,y,1", "", "3,120,1,1,1"]),
                       ("b", ["4,180,1,1,1,z,1", "5,240,1,1,1,z,1,too,many"])):
        write_csv(tmp_dir, name, "\n".join([head, *body]) + "\n")
    report = Observation()
    good, bad = raw.scan_ohlcv_csv(spark, f"{tmp_dir}/*.csv", rejects=True, report=report)
    assert sorted((r.Timestamp, r.Close, r.note) for r in good.collect()) == [(60.0, 1.0, "x"), (180.0, 4.0, "z")]
    assert raw.check_report(report, files=2) == {"rows": 5, "rejected": 3, "milliseconds": 0, "headers": 2}
    with pytest.raises(ValueError, match="3 of 5 rows"):
        raw.check_report(report, most_rejected=0.1)
    with pytest.raises(ValueError, match="2 of 3 files"):
        raw.check_report(report, files=3)
    assert bad.count() == 3
    late = Observation()
    path = write_csv(tmp_dir, "late", "Timestamp,Open,High,Low,Close,Volume\n1e13,1,1,1,1,1\n")
    raw.scan_ohlcv_csv(spark, path, rejects=True, report=late)[0].count()
    with pytest.raises(ValueError, match="milliseconds"):
        raw.check_report(late)


def test_ticks_without_sequence_or_time(spark):
    import datetime as dt
    schema = "symbol string, ts timestamp_ntz, seq long, Open double, High double, Low double, Close double, Volume double"
    tick = lambda h, seq, p: ("A", None if h is None else dt.datetime(2024, 1, 1, h), seq, p, p, p, p, 1.0)
    day = daily_ohlcv(spark.createDataFrame([tick(9, None, 1.0), tick(10, 5, 2.0)], schema)).first()
    assert (day.Open, day.Close) == (1.0, 2.0)
    day = daily_ohlcv(spark.createDataFrame([tick(9, None, 1.0), tick(9, 1, 2.0), tick(9, 0, 3.0)], schema)).first()
    assert (day.Open, day.Close) == (1.0, 2.0)
    day = daily_ohlcv(spark.createDataFrame([tick(9, None, 1.0)], schema)).first()
    assert (day.Open, day.Close) == (1.0, 1.0)
    with pytest.raises(Exception, match="no time"):
        daily_ohlcv(spark.createDataFrame([tick(None, 1, 1.0)], schema)).collect()


def test_small_helpers(spark, tmp_dir):
    import datetime as dt
    from daycast.functions.values import parse_datetime, safe_float
    from daycast.operators.bars import sort_by_date
    from daycast.operators.folds import expanding_folds, fold_bounds
    texts = ["2024-01-02 03:04:05.000006", "2024-01-02 03:04:05", "2024-01-02", "nonsense", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in df.select("i", parse_datetime(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got[:3] == [dt.datetime(2024, 1, 2, 3, 4, 5, 6), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2)]
    assert got[3:] == [None, None]
    num = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in num.select(safe_float(F.col("x"))).collect()] == [1.5, 0.0, 0.0]
    bars = spark.createDataFrame([("b", dt.date(2024, 1, 2)), ("a", dt.date(2024, 1, 3)), ("a", dt.date(2024, 1, 1))],
                                 "symbol string, Date date")
    assert [(r.symbol, r.Date.day) for r in sort_by_date(bars).collect()] == [("a", 1), ("a", 3), ("b", 2)]
    days = spark.createDataFrame([("a", dt.date(2024, 1, i + 1)) for i in range(6)], "symbol string, Date date")
    edge = fold_bounds(expanding_folds(days, 2)).orderBy("fold").collect()
    assert [(r.train_end.day, r.test_start.day, r.n_train, r.n_test) for r in edge] == [(2, 3, 2, 2), (4, 5, 4, 2)]
    processed = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], raw.PROCESSED_COLUMNS)
    io.sink_processed(processed, f"{tmp_dir}/p")
    assert io.scan_processed(spark, f"{tmp_dir}/p").columns == raw.PROCESSED_COLUMNS
