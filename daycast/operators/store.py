"""Versioned forecast store: run index, newest-run-wins merge, reads.

Tables are keyed by (symbol, model); every rule of the single-series
store applies per key, all keys in one query:

* the run index holds one row per (symbol, model, run_date); a second
  upload of the same key is an error unless ``force`` replaces it;
* merging a run keeps current rows with ``target_date < run_date``
  untouched, and for later dates the newest run wins; the run only
  contributes rows after its as-of day (``target_date > as_of``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daycast.operators import manifest as mf
from daycast.session import stored
from daycast.sources.schemas import CURRENT, FORECAST_PAYLOAD, FORECAST_ROW, RUNS

RUN_KEY = ["symbol", "model", "run_date"]
SERIES = ["symbol", "model"]


# --- rows in -------------------------------------------------------------------

def rows_to_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A forecast payload's row list → (target_date, prediction) frame; a whole
    number is a prediction too."""
    if not rows:
        raise ValueError("a forecast needs at least one row")
    try:
        plain = [(str(r["target_date"]), None if r["prediction"] is None else float(r["prediction"]))
                 for r in rows]
    except (KeyError, TypeError, ValueError) as exc:
        raise ValueError("every forecast row holds a target_date and a numeric prediction") from exc
    return spark.createDataFrame(plain, FORECAST_ROW).withColumn("target_date", F.to_date("target_date"))


def explode_payloads(payloads: DataFrame) -> DataFrame:
    """Uploaded payload records → one forecast row per element, with the key
    (symbol, model, run_date) and ``force``. A payload without rows is refused: it
    fails the job rather than vanish."""
    some = F.when(F.size("rows") > 0, F.col("rows")).otherwise(F.raise_error(F.concat(
        F.lit("payload without rows: "), F.coalesce("symbol", F.lit("?")), F.lit(" "),
        F.coalesce("model", F.lit("?")))).cast(payloads.schema["rows"].dataType))
    return (payloads.select("*", F.explode(some).alias("r"))
                    .select("symbol", "model", F.to_date("run_date").alias("run_date"), "horizon",
                            "params", F.coalesce("force", F.lit(False)).alias("force"),
                            F.to_date("r.target_date").alias("target_date"),
                            F.col("r.prediction").cast("double").alias("prediction")))


def save_payloads(spark: SparkSession, base: str, payloads: DataFrame,
                  as_of: dt.date | None = None) -> mf.Version:
    """Store uploaded payloads as runs; one stored already needs ``force``."""
    keys = payloads.select("symbol", "model", F.to_date("run_date").alias("run_date"),
                           F.coalesce("force", F.lit(False)).alias("force"))
    return save_run(spark, base, explode_payloads(payloads), F.first("horizon"), as_of=as_of,
                    keys=keys.where("not force"), params_of=F.first("params"), force=True)


# --- text forms ------------------------------------------------------------------

def day_text(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A day as text (ISO by default)."""
    return F.date_format(c, pattern)


def number_text(c: Column, digits: int | None = None) -> Column:
    """A number as text, with a fixed number of decimals if given."""
    return c.cast("string") if digits is None else F.format_string(f"%.{digits}f", c.cast("double"))


def merge_params(base: Column, over: Column) -> Column:
    """Two parameter maps in one; the second wins, null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(base, empty), lambda k, v: ~F.array_contains(
        F.map_keys(F.coalesce(over, empty)), k))
    return F.map_concat(kept, F.coalesce(over, empty))


def params_json(params: Column) -> Column:
    """A parameter map as JSON text, keys in order."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(params))))


def add_if_absent(df: DataFrame, **values) -> DataFrame:
    """Add literal columns (model, run_date, symbol, ...) missing from df."""
    add = {k: F.lit(v) for k, v in values.items() if v is not None and k not in df.columns}
    return df.withColumns(add) if add else df


# --- run index -----------------------------------------------------------------

def run_rows(forecasts: DataFrame, horizon: int | Column | None = None,
             params: dict | None = None, params_of: Column | None = None) -> DataFrame:
    """Run index rows of forecast rows: one per (symbol, model, run_date).

    ``horizon`` and ``params_of`` may be aggregates over a run's rows."""
    p = (F.create_map(*[F.lit(x) for kv in sorted((params or {}).items()) for x in
                        (kv[0], str(kv[1]))]) if params
         else F.lit(None).cast("map<string,string>"))
    h = horizon if isinstance(horizon, Column) else F.max(F.lit(horizon))
    return (forecasts.groupBy(*RUN_KEY)
                     .agg(F.count(F.lit(1)).alias("rows_count"), h.cast("int").alias("horizon"),
                          (F.first(p) if params_of is None else params_of).alias("params"))
                     .select(*RUN_KEY, "horizon", "rows_count", "params"))


def existing_runs(index: DataFrame, new_runs: DataFrame) -> DataFrame:
    """Index rows whose key is also in new_runs (left semi join)."""
    return index.join(new_runs.select(*RUN_KEY), RUN_KEY, "left_semi")


def replace_run(index: DataFrame, new_runs: DataFrame) -> DataFrame:
    """Drop index rows with a key of new_runs, then add new_runs."""
    kept = index.join(new_runs.select(*RUN_KEY).distinct(), RUN_KEY, "left_anti")
    return kept.unionByName(new_runs, allowMissingColumns=True)


def upsert_run(index: DataFrame, new_runs: DataFrame, force: bool = False) -> DataFrame:
    """Insert run rows; an existing (symbol, model, run_date) raises unless
    ``force``. The duplicate test stops at the first matching row."""
    if not force and not existing_runs(index, new_runs).isEmpty():
        raise FileExistsError("a run of this symbol, model and run_date is stored already; "
                              "force=True takes its place")
    return replace_run(index, new_runs)


# --- current forecast -------------------------------------------------------------

def future_only(df: DataFrame, as_of: dt.date | Column | None = None) -> DataFrame:
    """Keep rows for days after the as-of day (default: each row's run_date)."""
    a = F.col("run_date") if as_of is None else (as_of if isinstance(as_of, Column)
                                                  else F.lit(as_of))
    return df.where(F.col("target_date") > a)


def latest_per_target(forecasts: DataFrame) -> DataFrame:
    """Newest run's prediction per (symbol, model, target_date).

    A hash aggregate with primitive buffers (max_by on a date): partial
    per task, so a day covered by many runs never piles up in one place.
    """
    return (forecasts.groupBy("symbol", "model", "target_date")
                     .agg(F.max_by("prediction", "run_date").alias("prediction"),
                          F.max("run_date").alias("run_date")))


def merge_current(current: DataFrame, incoming: DataFrame,
                  run_date: dt.date | None = None, model: str | None = None,
                  as_of: dt.date | None = None) -> DataFrame:
    """Merge an incoming run (per series) into the current forecast.

    Rows of ``current`` with ``target_date`` before the incoming run_date
    of their series are kept as they are; for later dates the newest run
    wins (on equal run_date the incoming row wins). Series without an
    incoming run keep their rows. One exchange on (symbol, model).
    """
    inc = add_if_absent(incoming, model=model, run_date=run_date)
    inc = inc.withColumn("target_date", F.to_date("target_date")) \
             .withColumn("run_date", F.to_date("run_date")) \
             .withColumn("prediction", F.col("prediction").cast("double"))
    inc = future_only(inc, as_of)
    cols = [f.name for f in CURRENT.fields]
    both = (current.select(*cols).withColumn("_src", F.lit(0))
            .unionByName(inc.select(*cols).withColumn("_src", F.lit(1))))
    # One sort serves both windows: rows of a series ordered by day, newest
    # run first (incoming first on a tie); the first row of each day wins.
    ordered = Window.partitionBy(*SERIES).orderBy(
        F.col("target_date"), F.col("run_date").desc(), F.col("_src").desc())
    prev_day = F.lag("target_date", 1).over(ordered)
    inc_run = F.max(F.when(F.col("_src") == 1, F.col("run_date"))).over(
        Window.partitionBy(*SERIES))
    ranked = both.withColumn("_first", prev_day.isNull() | (prev_day != F.col("target_date"))) \
                 .withColumn("_inc_run", inc_run)
    keep = (F.col("_inc_run").isNull() | (F.col("target_date") < F.col("_inc_run"))
            | F.col("_first"))
    return ranked.where(keep).select(*cols)


def get_current(current: DataFrame, model: str) -> DataFrame:
    """Current forecast of one model (partition pruning when stored by model)."""
    return current.where(F.col("model") == model)


def forecast_table(current: DataFrame, horizon: int, digits: int = 2) -> DataFrame:
    """The next ``horizon`` forecast days per (symbol, model), rounded."""
    w = Window.partitionBy(*SERIES).orderBy("target_date")
    return (current.withColumn("_n", F.row_number().over(w))
                   .where(F.col("_n") <= horizon)
                   .select("symbol", "model", F.col("target_date").alias("Date"),
                           F.round("prediction", digits).alias("Predicted Price")))


# --- freshness ---------------------------------------------------------------------

def is_stale(bars: DataFrame | None, as_of: dt.date, date_col: str = "Date",
             series: DataFrame | None = None) -> DataFrame:
    """Per symbol: last bar date and whether it is not the day before as_of.

    With ``series`` (the symbols that should be there) a symbol without bars, or a
    table that is absent (None) or empty, is stale rather than missing."""
    if bars is None and series is None:
        raise ValueError("without a table the series to report must be given")
    if bars is None:
        last = series.select("symbol").distinct().withColumn("last_date", F.lit(None).cast("date"))
    else:
        last = bars.groupBy("symbol").agg(F.max(F.col(date_col)).alias("last_date"))
        if series is not None:
            last = series.select("symbol").distinct().join(last, "symbol", "left")
    return last.withColumn(
        "stale", F.coalesce(F.col("last_date") != F.date_sub(F.lit(as_of), 1), F.lit(True)))


def needs_forecast(series: DataFrame, current: DataFrame, as_of: dt.date) -> DataFrame:
    """Per (symbol, model): a new forecast is due when no row exists for
    the day after as_of, or when that row comes from an older run."""
    tomorrow = current.where(F.col("target_date") == F.date_add(F.lit(as_of), 1)) \
                      .select(*SERIES, F.col("run_date").alias("tomorrow_run"))
    return (series.select(*SERIES).distinct()
                  .join(tomorrow, SERIES, "left")
                  .withColumn("needs_forecast",
                              F.coalesce(F.col("tomorrow_run") != F.lit(as_of), F.lit(True))))


# --- storage -------------------------------------------------------------------------

# One table of the store's partitions: runs by month of the run date, current forecasts
# by model and month of the target day.

def sink_atomic(df: DataFrame, path: str, partition_by: list[str] | None = None,
                keep: int | None = mf.KEEP_VERSIONS) -> str:
    """Write df as the next version of the table at path and return its folder; readers
    switch to it only with the commit. Of two writers at once one is refused. The last
    ``keep`` versions stay (None: all)."""
    spark = df.sparkSession
    before, folder = mf.newest(spark, path), mf.new_folder()
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path}/{folder}")
    _commit(spark, path, before, {"table": folder}, folder, keep)
    return f"{path}/{folder}"


def _commit(spark: SparkSession, base: str, before: mf.Version, changed: dict, folder: str,
            keep: int | None = mf.KEEP_VERSIONS) -> mf.Version:
    try:
        return mf.commit(spark, base, before, changed, keep)
    except mf.ConcurrentCommitError:
        mf.remove(spark, base, folder)
        raise


def latest_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest committed version of a ``sink_atomic`` table."""
    folder = mf.newest(spark, path).partitions.get("table")
    return folder and f"{path}/{folder}"


def scan_versioned(spark: SparkSession, path: str, schema) -> DataFrame:
    """Newest version of a ``sink_atomic`` table, or an empty frame when none exists."""
    return mf.scan(spark, path, schema, prefix="table")


def scan_runs(spark: SparkSession, base: str) -> DataFrame:
    return mf.scan(spark, base, RUNS, prefix="runs/")


def scan_current(spark: SparkSession, base: str, model: str | None = None) -> DataFrame:
    """Current forecast; of one model, only its partitions are read."""
    return mf.scan(spark, base, CURRENT, prefix="current/" if model is None else f"current/{model}/")


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def _changed(rows: DataFrame, keys: Column, base: str, folder: str) -> dict[str, str]:
    """Write ``rows`` by partition key to ``folder`` and name the folder of each."""
    part = F.substring(F.sha2("_key", 256), 1, 24)           # a name any file system takes
    kept = rows.withColumn("_key", keys).withColumn("_part", part).persist()
    try:
        # a row per partition the run touches: models by months
        names = kept.select("_key", "_part").distinct().collect()
        kept.drop("_key").repartition("_part").write.partitionBy("_part").parquet(f"{base}/{folder}")
    finally:
        kept.unpersist()
    return {r["_key"]: f"{folder}/_part={r['_part']}" for r in names}


def save_run(spark: SparkSession, base: str, forecasts: DataFrame, horizon: int | Column,
             params: dict | None = None, force: bool = False, as_of: dt.date | None = None,
             keys: DataFrame | list[tuple] | None = None,
             params_of: Column | None = None) -> mf.Version:
    """Store a run and return the version it made.

    The duplicate check comes first; with ``keys``, the run's (symbol, model, run_date),
    a duplicate is refused before the forecast is computed at all. The forecast is
    computed once, written in the shared folder. Only the (model, month) partitions that
    hold one of its target days, and the months of its run dates, are read, merged and
    written, all models in one job; one commit switches readers to them together. A
    writer who was overtaken is refused and leaves nothing behind.
    """
    before = mf.newest(spark, base)
    if isinstance(keys, list):
        keys = spark.createDataFrame(keys, "symbol string, model string, run_date date")
    if keys is not None:
        if not force or params_of is not None:      # payload keys hold those without force only
            upsert_run(mf.scan(spark, base, RUNS, before, "runs/"), keys, force=False)
    forecasts = stored(forecasts, "run")
    new_runs = run_rows(forecasts, horizon, params, params_of)
    months = {r[0] for r in new_runs.select(_month("run_date")).distinct().collect()}
    index = _of(spark, base, before, RUNS, [f"runs/{m}" for m in months])
    new_index = upsert_run(index, new_runs, force)
    incoming = future_only(forecasts.withColumn("target_date", F.to_date("target_date"))
                           .withColumn("run_date", F.to_date("run_date")), as_of)
    key = F.concat_ws("/", F.lit("current"), "model", _month("target_date"))
    touched = [r[0] for r in incoming.select(key).distinct().collect()]
    merged = merge_current(_of(spark, base, before, CURRENT, touched), forecasts, as_of=as_of)
    folder = mf.new_folder()
    changed = _changed(new_index, F.concat(F.lit("runs/"), _month("run_date")), base, f"{folder}/runs")
    changed |= _changed(merged, key, base, f"{folder}/current")
    return _commit(spark, base, before, changed, folder)


def _of(spark: SparkSession, base: str, version: mf.Version, schema, keys: list[str]) -> DataFrame:
    """Rows of the named partitions of a version."""
    held = mf.Version(version.number, {k: version.partitions[k] for k in keys if k in version.partitions})
    return mf.scan(spark, base, schema, held)


PAYLOAD_SCHEMA = FORECAST_PAYLOAD
