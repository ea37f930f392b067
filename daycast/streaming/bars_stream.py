"""Structured Streaming: daily bars from arriving ticks, and incremental
feature refresh per micro-batch.

* ``stream_daily_ohlcv`` — event-time ``window(ts, '1 day')`` per symbol
  with a watermark; append mode emits a day once the watermark passes its
  end, so late ticks up to the allowed lateness still land in their day.
* ``incremental_features`` — ``foreachBatch``: each batch's new days get
  their feature rows from a state of one row per symbol (rows seen, last 180
  bars) in hash buckets, written per epoch so replays are idempotent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from daycast.functions.values import no_nan, utc_date
from daycast.operators.bars import tick_order_key
from daycast.operators.features import RETURN_PERIODS, feature_table
from daycast.session import checkpoint_dir
from daycast.sources.schemas import TICKS


def read_tick_stream(spark: SparkSession, path: str, schema=None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving under ``path`` (a folder or glob), fixed schema."""
    r = spark.readStream.schema(schema or TICKS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_daily_ohlcv(ticks: DataFrame, lateness: str = "1 day", ts: str = "ts",
                       seq: str = "seq") -> DataFrame:
    """Streaming bars (symbol, Date, OHLCV); ``ts`` must be a TIMESTAMP
    (see ``utc_instant``); days are UTC days whatever the session zone."""
    order = tick_order_key(ts, seq, T.TimestampType())
    return (ticks.withWatermark(ts, lateness)
                 .groupBy(F.col("symbol"), F.window(F.col(ts), "1 day").alias("w"))
                 .agg(F.min_by(F.col("Open"), order).alias("Open"),
                      F.max(no_nan(F.col("High"))).alias("High"),
                      F.min(no_nan(F.col("Low"))).alias("Low"),
                      F.max_by(F.col("Close"), order).alias("Close"),
                      F.coalesce(F.sum(F.col("Volume")), F.lit(0.0)).alias("Volume"))
                 .select("symbol", utc_date(F.col("w.start")).alias("Date"),
                         "Open", "High", "Low", "Close", "Volume"))


def run_available(df: DataFrame, sink_path: str, ckpt_path: str, mode: str = "append",
                  partition_by: list[str] | None = None) -> None:
    """Process everything available now into a Parquet sink, then stop."""
    w = (df.writeStream.format("parquet").outputMode(mode)
           .option("path", sink_path).option("checkpointLocation", ckpt_path)
           .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()


def scratch_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Sink and checkpoint folders under the shared checkpoint directory."""
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/_checkpoint"


LOOKBACK = max(RETURN_PERIODS)   # rows of history the widest feature needs
BAR_NAMES = ["symbol", "Date", "Open", "High", "Low", "Close", "Volume"]


def series_state(bars: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(symbol, n, tail): rows seen of each symbol and its last LOOKBACK bars.

    ``before`` is the state the bars are added to; symbols without new bars keep
    theirs. A row is bounded by LOOKBACK, whatever the history.
    """
    bar = F.struct(*BAR_NAMES[1:])
    new = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.collect_list(bar).alias("tail"))
    if before is not None:
        new = before.unionByName(new).groupBy("symbol").agg(
            F.sum("n").alias("n"), F.flatten(F.collect_list("tail")).alias("tail"))
    newest = F.reverse(F.sort_array("tail"))
    return new.select("symbol", "n", F.sort_array(F.slice(newest, 1, LOOKBACK)).alias("tail"))


def incremental_feature_rows(state: DataFrame | None, new_bars: DataFrame, calendar,
                             fill: float = 0.0) -> DataFrame:
    """Feature rows for the days of ``new_bars`` only, from the state of the touched
    symbols (exact: no feature looks further back). ``trend`` keeps counting from the
    rows seen before, so the rows equal a full recompute."""
    if state is None:
        return feature_table(new_bars.select(*BAR_NAMES), calendar, fill)
    first_new = new_bars.groupBy("symbol").agg(F.min("Date").alias("_first_new"))
    touched = state.join(first_new, "symbol")
    old = touched.select("symbol", F.explode("tail").alias("b")).select("symbol", "b.*")
    ft = feature_table(old.select(*BAR_NAMES).unionByName(new_bars.select(*BAR_NAMES)), calendar, fill)
    offset = touched.select("symbol", (F.col("n") - F.size("tail")).alias("_offset"))
    return (ft.join(first_new, "symbol").where(F.col("Datetime") >= F.col("_first_new"))
              .join(offset, "symbol", "left")
              .withColumn("trend", F.col("trend") + F.coalesce(F.col("_offset"), F.lit(0)))
              .drop("_first_new", "_offset"))


STATE_BUCKETS = 256
STATE_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("tail", T.ArrayType(T.StructType(
        [T.StructField("Date", T.DateType())] + [T.StructField(c, T.DoubleType()) for c in BAR_NAMES[2:]]))),
])


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")


def _state_epochs(spark: SparkSession, path: str, before: int) -> dict[int, list[int]]:
    """bucket -> committed epochs older than ``before`` that wrote it, oldest first."""
    fs, p, jvm = _fs(spark, path)
    out: dict[int, list[int]] = {}
    if not fs.exists(p):
        return out
    epochs = sorted(int(n[6:]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("epoch="))
    for e in epochs:
        folder = f"{path}/epoch={e}"
        if e < before and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
            for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
                name = s.getPath().getName()
                if name.startswith("bucket="):
                    out.setdefault(int(name[7:]), []).append(e)
    return out


def read_state(spark: SparkSession, path: str, buckets: list[int] | None = None, before: int = 1 << 62) -> DataFrame | None:
    """State of the symbols in some buckets (None: all), each bucket from the newest
    epoch that wrote it; None when there is none."""
    held = _state_epochs(spark, path, before)
    paths = [f"{path}/epoch={e[-1]}/bucket={b}" for b, e in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.schema(STATE_SCHEMA).parquet(*paths) if paths else None


def _forget(spark: SparkSession, path: str, held: dict[int, list[int]], touched: list[int]) -> None:
    """Of the buckets just written, versions before the last one are not read again,
    not even by a replay."""
    fs, _, jvm = _fs(spark, path)
    for b in touched:
        for e in held.get(b, [])[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={e}/bucket={b}"), True)


def incremental_features(bars_path: str, features_path: str, calendar, fill: float = 0.0,
                         state_path: str | None = None, buckets: int = STATE_BUCKETS):
    """foreachBatch handler: feature rows for the batch's days from a small state.

    The state, one row per symbol, is dealt to ``buckets`` by symbol hash; a batch reads
    and writes the buckets of the symbols it holds only, whatever the number of symbols.
    Idempotent under retries: a micro-batch writes its bars, its feature rows and the
    touched buckets to its own ``epoch=<id>`` folders in overwrite mode and reads buckets
    of earlier epochs only, so a replayed epoch replaces its earlier attempt. Readers see
    the union of all epochs' bars and feature rows.
    """
    state_path = state_path or f"{features_path}_state"

    def handle(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            # at most ``buckets`` numbers
            touched = [r[0] for r in batch.select(_bucket(buckets)).distinct().collect()]
            held = _state_epochs(spark, state_path, epoch_id)
            state = read_state(spark, state_path, touched, epoch_id)
            incremental_feature_rows(state, batch, calendar, fill).write.mode("overwrite") \
                .parquet(f"{features_path}/epoch={epoch_id}")
            batch.write.mode("overwrite").parquet(f"{bars_path}/epoch={epoch_id}")
            series_state(batch, state).withColumn("bucket", _bucket(buckets)).repartition("bucket") \
                .write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/epoch={epoch_id}")
            _forget(spark, state_path, held, touched)
        finally:
            batch.unpersist()

    return handle


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def run_incremental_features(bars_stream: DataFrame, bars_path: str, features_path: str,
                             ckpt_path: str, calendar) -> None:
    q = (bars_stream.writeStream.outputMode("append")
         .foreachBatch(incremental_features(bars_path, features_path, calendar))
         .option("checkpointLocation", ckpt_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
