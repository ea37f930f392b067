"""Model fit / predict / save / load and k-fold cross-validation.

* Linear: least squares per series from mergeable factors. Every block of a
  series' rows is reduced to the triangular factor of its QR decomposition (as
  many rows as columns), the factors of a series are stacked and factored again,
  and a small solve gives the coefficients; so Spark spreads and combines the
  work, and a series of any length never meets in one task. Prediction is a JVM
  dot product after a join on ``symbol``.
* Boosted trees: one ``pyspark.ml`` pipeline fitted on all series at once. Each
  row also carries its series' level and scale (mean and deviation of the training
  Close), so the pooled model knows which series it is in; no bit parity with
  other boosters.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daycast.functions.values import mae, mape, rmse
from daycast.operators import factors as fa
from daycast.operators import folds as fo
from daycast.session import checkpoint_dir, stored

KNOWN_MODELS = ("linear", "xgboost")
# Boosted-tree settings of the forecast service and of the unit test.
GBT_SERVICE_PARAMS = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05,
                      "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
GBT_TEST_PARAMS = {"maxIter": 50, "maxDepth": 3, "stepSize": 0.1, "seed": 42}
LEVEL_COLS = ["series_level", "series_scale"]
ROWS_PER_TASK = 20_000   # rows of one task of a boosted fit
FIT_BLOCKS = 16          # blocks a series' rows are dealt to for the linear fit
FACTOR_ROWS = 2048       # rows of one factor between two fold edges, at most

COEF_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("coef", T.ArrayType(T.DoubleType())),
    T.StructField("n_rows", T.LongType()),
])


class NotFittedError(ValueError):
    """Predictions were asked of a model that was not fitted."""


def fitted(model):
    """The model itself; one that is absent or holds no fit is refused."""
    if model is None or isinstance(model, TreeModel) and model.pipeline is None:
        raise NotFittedError("the model was not fitted")
    return model


def known_model(name: str) -> str:
    if name not in KNOWN_MODELS:
        raise ValueError(f"no model called {name!r}; there are {', '.join(KNOWN_MODELS)}")
    return name


def check_model_inputs(df: DataFrame, feature_cols: list[str], target: str | None = "Close",
                       check_empty: bool = True) -> DataFrame:
    """Schema checks on the driver; the emptiness probe stops at one row."""
    missing = [c for c in feature_cols + ([target] if target else []) if c not in df.columns]
    if missing:
        raise ValueError(f"the frame lacks the model columns {missing}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    other = [c for c in feature_cols + ([target] if target else [])
             if not isinstance(kinds.get(c), (T.NumericType, T.BooleanType, type(None)))]
    if other:
        raise ValueError(f"the model columns {other} are not numbers")
    if check_empty and df.isEmpty():
        raise ValueError("there are no rows to fit on")
    return df


# --- linear, one fit per series ----------------------------------------------------------

def ols_fit(df: DataFrame, feature_cols: list[str], target: str = "Close",
            key: str = "symbol", blocks: int = FIT_BLOCKS) -> DataFrame:
    """Coefficient table (symbol, intercept, coef[], n_rows). Rows without a target
    are left out, null inputs count as 0."""
    check_model_inputs(df, feature_cols, target, check_empty=False)
    return fit_rows(df.select(F.col(key).alias("symbol"), F.col(target).cast("double").alias("y"),
                              fa.inputs(feature_cols).alias("x")), len(feature_cols), blocks)


def fit_rows(rows: DataFrame, width: int, blocks: int = FIT_BLOCKS) -> DataFrame:
    """``ols_fit`` of rows (symbol, y, x), x an array of ``width`` inputs."""
    data = rows.where("y IS NOT NULL").select("symbol", "y", "x", F.pmod(
        F.xxhash64("y", "x"), F.lit(blocks)).alias("_block"))

    def factor(key: tuple, table: pa.Table) -> pa.Table:
        return fa.factor(table, width).append_column("symbol", pa.array([key[0].as_py()], pa.string()))

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        n = sum(table["n"].to_pylist())
        beta = fa.solve(fa.stacked(table["r"], width), n)
        return pa.table({"symbol": pa.array([key[0].as_py()], pa.string()), "intercept": [float(beta[0])],
                         "coef": [beta[1:].tolist()], "n_rows": [n]})

    factors = data.groupBy("symbol", "_block").applyInArrow(factor, f"{fa.FACTOR_SCHEMA}, symbol string")
    return factors.groupBy("symbol").applyInArrow(solve, COEF_SCHEMA)


def dot_array(coef: str, intercept: str, x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.aggregate(F.zip_with(F.col(coef), x, lambda b, v: b * v), F.col(intercept),
                       lambda acc, v: acc + v)


def dot(coef: str, intercept: str, feature_cols: list[str]) -> Column:
    return dot_array(coef, intercept, F.array(*[F.col(c).cast("double") for c in feature_cols]))


def ols_predict(coefs: DataFrame, df: DataFrame, feature_cols: list[str],
                key: str = "symbol") -> DataFrame:
    """Rows of df + ``prediction`` (JVM dot product after a join on the key;
    the coefficient side is one row per series). A series without coefficients
    keeps its rows, with a null prediction."""
    check_model_inputs(df, feature_cols, None, check_empty=False)
    j = df.join(fitted(coefs).select(F.col("symbol").alias(key), "intercept", "coef"), key, "left")
    return j.withColumn("prediction", dot("coef", "intercept", feature_cols)).drop("intercept", "coef")


def save_coefficients(coefs: DataFrame, path: str, feature_cols: list[str]) -> None:
    """Coefficients with their feature list, so a load can never misalign them."""
    (coefs.withColumn("feature_cols", F.array(*[F.lit(c) for c in feature_cols]))
          .write.mode("overwrite").parquet(path))


def load_coefficients(spark, path: str) -> tuple[DataFrame, list[str]]:
    df = spark.read.parquet(path)
    row = df.select("feature_cols").first()
    cols = list(row["feature_cols"]) if row else []
    return df.drop("feature_cols"), cols


# --- boosted trees (pyspark.ml) ------------------------------------------------------------

@dataclass
class TreeModel:
    """A fitted pipeline with what it needs to be used rightly."""

    pipeline: PipelineModel
    features: list[str]
    params: dict
    levels: DataFrame | None           # (symbol, series_level, series_scale)
    as_of: dt.date | None = None

    @property
    def inputs(self) -> list[str]:
        return self.features + (LEVEL_COLS if self.levels is not None else [])

    def meta(self) -> str:
        return json.dumps({"features": self.features, "params": self.params,
                           "as_of": self.as_of.isoformat() if self.as_of else None}, sort_keys=True)


def gbt_pipeline(feature_cols: list[str], target: str = "Close", params: dict | None = None,
                 cache_node_ids: bool = False) -> Pipeline:
    p = dict(GBT_SERVICE_PARAMS if params is None else params)
    assembler = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction",
                       cacheNodeIds=cache_node_ids, checkpointInterval=10, **p)
    return Pipeline(stages=[assembler, gbt])


def _with_levels(df: DataFrame, levels: DataFrame | None) -> DataFrame:
    if levels is None:
        return df
    return (df.join(levels, "symbol", "left")
            .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in LEVEL_COLS}))


def series_levels(df: DataFrame, target: str = "Close") -> DataFrame:
    return df.groupBy("symbol").agg(F.avg(target).alias(LEVEL_COLS[0]),
                                    F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias(LEVEL_COLS[1]))


def gbt_fit(df: DataFrame, feature_cols: list[str], target: str = "Close", params: dict | None = None,
            as_of: dt.date | None = None, with_levels: bool = True) -> TreeModel:
    """Pooled boosted trees; the training rows are computed once. Without levels the
    model does not know which series a row is of."""
    check_model_inputs(df, feature_cols, target, check_empty=False)
    checkpoint_dir(df.sparkSession)
    data = df.select("symbol", *[F.col(c).cast("double").alias(c) for c in feature_cols],
                     F.col(target).cast("double").alias(target)).checkpoint(eager=True)
    check_model_inputs(data, feature_cols, target)
    # daily rows are few: a tree's many small jobs cost their task count
    tasks = -(-data.count() // ROWS_PER_TASK)
    data = data.coalesce(max(1, tasks))
    levels = series_levels(data, target).checkpoint(eager=True) if with_levels else None
    model = TreeModel(None, list(feature_cols), dict(GBT_SERVICE_PARAMS if params is None else params),
                      levels, as_of)
    model.pipeline = gbt_pipeline(model.inputs, target, model.params).fit(_with_levels(data, levels))
    return model


def known_features(model: TreeModel, columns: list[str]) -> None:
    missing = [c for c in model.features if c not in columns]
    if missing:
        raise ValueError(f"the model was fitted on columns that are not there: {missing}")


def gbt_predict(model: TreeModel, df: DataFrame) -> DataFrame:
    known_features(fitted(model), df.columns)
    check_model_inputs(df, model.features, None, check_empty=False)
    return model.pipeline.transform(_with_levels(df, model.levels)).drop("features", *LEVEL_COLS)


def gbt_predict_file(model: TreeModel, spark: SparkSession, path: str) -> DataFrame:
    """Predictions for a feature file; its columns are checked, not its order."""
    return gbt_predict(model, spark.read.parquet(path))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_model(model: TreeModel, spark: SparkSession, path: str) -> None:
    """Pipeline, series levels and, last, what they were fitted on."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    if model.levels is not None:
        model.levels.write.mode("overwrite").parquet(f"{path}/levels")
    spark.createDataFrame([(model.meta(),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> TreeModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return TreeModel(PipelineModel.load(f"{path}/pipeline"), meta["features"], meta["params"],
                     spark.read.parquet(f"{path}/levels") if _exists(spark, f"{path}/levels") else None,
                     dt.date.fromisoformat(meta["as_of"]) if meta["as_of"] else None)


def model_path(base: str, name: str, symbol: str, as_of: dt.date) -> str:
    return f"{base}/model={known_model(name)}/symbol={symbol}/as_of={as_of.isoformat()}"


def train_or_load(path: str | None, df: DataFrame, feature_cols: list[str],
                  params: dict | None = None, as_of: dt.date | None = None) -> TreeModel:
    """The saved model if it was fitted on these features, settings and as-of day;
    else a new fit, which takes its place."""
    spark = df.sparkSession
    wanted = TreeModel(None, list(feature_cols), dict(GBT_SERVICE_PARAMS if params is None else params),
                       None, as_of)
    if path and _exists(spark, f"{path}/meta/_SUCCESS"):
        held = load_model(spark, path)
        if held.meta() == wanted.meta():
            return held
    model = gbt_fit(df, feature_cols, params=params, as_of=as_of)
    if path:
        save_model(model, spark, path)
    return model


# --- cross-validation ------------------------------------------------------------------------

PREFIX_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("fold", T.IntegerType()),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("coef", T.ArrayType(T.DoubleType())),
])


def fold_segments(df: DataFrame, k: int, order: str) -> DataFrame:
    """df + ``_i`` (row of the series) and ``_seg``: 0 before the first test, f + 1 in
    the test of fold f; null where the series is too short for the split. Fold f
    trains on segments 0..f."""
    w = Window.partitionBy("symbol").orderBy(order)
    rows = df.withColumns({"_i": (F.row_number().over(w) - 1).cast("long"),
                           "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    ts = F.floor(F.col("_n") / F.lit(k + 1)).cast("long")
    after = F.col("_i") - (F.col("_n") - F.lit(k) * ts)      # rows since the first test row
    return rows.withColumn("_seg", F.when(ts > 0, F.when(after < 0, F.lit(0)).otherwise(
        F.floor(F.try_divide(after, ts)) + 1)).cast("int")).drop("_n")


def prefix_coefficients(rows: DataFrame, width: int, k: int) -> DataFrame:
    """(symbol, fold, intercept, coef) of the fits on segments 0..fold of ``rows``
    (symbol, _i, _seg, y, x), x an array of ``width`` inputs.

    Every block of at most ``FACTOR_ROWS`` rows between two fold edges becomes one
    triangular factor; a series' factors, k + 1 of them and a few more for a long one,
    are merged from the left, and each merge gives one fold's fit.
    """
    train = rows.where(F.col("y").isNotNull() & (F.col("_seg") < k)) \
        .select("symbol", "_seg", F.floor(F.col("_i") / F.lit(FACTOR_ROWS)).alias("_block"), "y", "x")

    def factor(key: tuple, table: pa.Table) -> pa.Table:
        return fa.factor(table, width).append_column("symbol", pa.array([key[0].as_py()], pa.string())) \
            .append_column("seg", pa.array([key[1].as_py()], pa.int32()))

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        n, out, held, seg = 0, [], np.zeros((0, width + 2)), table["seg"].to_numpy()
        for f in range(k):
            part = table.filter(pa.array(seg == f))
            n += sum(part["n"].to_pylist())
            held = np.vstack([held, fa.stacked(part["r"], width)])
            if n:                              # no row with a target yet: no fit
                held = fa.triangle(held)
                beta = fa.solve(held, n)
                out.append((f, float(beta[0]), beta[1:].tolist()))
        fold, intercept, coef = ([r[i] for r in out] for i in range(3))
        return pa.table({"symbol": pa.array([key[0].as_py()] * len(out), pa.string()),
                         "fold": pa.array(fold, pa.int32()), "intercept": pa.array(intercept, pa.float64()),
                         "coef": pa.array(coef, pa.list_(pa.float64()))})

    factors = train.groupBy("symbol", "_seg", "_block") \
        .applyInArrow(factor, f"{fa.FACTOR_SCHEMA}, symbol string, seg int")
    return factors.groupBy("symbol").applyInArrow(solve, PREFIX_SCHEMA)


def _cv_linear(features: DataFrame, feature_cols: list[str], target: str, k: int,
               order: str = "Datetime") -> DataFrame:
    """Fold bounds and metrics per (symbol, fold) of the linear model."""
    rows = stored(fold_segments(features.select(
        "symbol", F.col(order).alias("Datetime"), F.col(target).cast("double").alias("y"),
        fa.inputs(feature_cols).alias("x")), k, "Datetime"), "cv")
    coefs = prefix_coefficients(rows, len(feature_cols), k).withColumn("_seg", F.col("fold") + 1).drop("fold")
    scored = rows.join(coefs, ["symbol", "_seg"], "left").withColumn("p", dot_array("coef", "intercept", "x"))
    test = F.col("_seg") > 0
    y, p = F.when(test, F.col("y")), F.when(test, F.col("p"))
    parts = scored.groupBy("symbol", "_seg").agg(
        F.min("Datetime").alias("_first"), F.max("Datetime").alias("_last"),
        mae(y, p).alias("MAE"), rmse(y, p).alias("RMSE"), fo.mape_test(F.col("y"), F.col("p"), test).alias("MAPE"))
    w = Window.partitionBy("symbol").orderBy("_seg")             # k + 1 rows a series
    some = F.col("_seg").isNotNull()
    return (parts.withColumns({"train_start": F.min("_first").over(w), "train_end": F.lag("_last").over(w)})
            .where(~some | test)
            .select("symbol", (F.col("_seg") - 1).alias("fold"),
                    *[F.when(some, F.col(c)).alias(n) for n, c in
                      (("train_start", "train_start"), ("train_end", "train_end"),
                       ("test_start", "_first"), ("test_end", "_last"))], "MAE", "RMSE", "MAPE"))


def fold_dates(df: DataFrame, k: int, order: str = "Datetime") -> list[tuple[dt.date, dt.date | None]]:
    """(first test day, first day after the test) of every fold, cut over all series'
    days, so no series trains on days another is tested on.

    The days are counted by month; only the months (a dozen rows a year) and the days
    of the k months that hold an edge reach the driver.
    """
    days = stored(df.select(F.col(order).cast("date").alias("d")).where("d IS NOT NULL").distinct()
                  .withColumn("m", F.trunc("d", "month")), "days")
    months = sorted((r["m"], r["count"]) for r in days.groupBy("m").count().collect())
    n = sum(c for _, c in months)
    ts = n // (k + 1)
    if ts == 0:
        return []
    wanted, at, places = [n - (k - f) * ts for f in range(k)], 0, []
    for m, c in months:
        places += [(m, i - at) for i in wanted if at <= i < at + c]
        at += c
    held: dict = {}
    for r in days.where(F.col("m").isin(sorted({m for m, _ in places}))).orderBy("d").collect():
        held.setdefault(r["m"], []).append(r["d"])
    starts = [held[m][i] for m, i in places]
    return list(zip(starts, [*starts[1:], None]))


def _in_pools(tasks: list) -> list:
    """Results of functions run at once, each in a scheduler pool of its own, so that
    the many small jobs of one do not wait for those of another."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    spark = SparkSession.active()

    def pooled(number: int, task):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number}")
        return task()
    with ThreadPoolExecutor(max(1, len(tasks))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(pooled), n, t) for n, t in enumerate(tasks)]
        return [r.result() for r in running]


def _cv_gbt(features: DataFrame, feature_cols: list[str], target: str, k: int, params: dict | None,
            with_levels: bool = True) -> DataFrame:
    """Fold bounds and metrics per (symbol, fold) of pooled fits, folds cut by date. The
    k fits (a small constant) run at once on the same stored rows."""
    rows = stored(features.select("symbol", "Datetime", F.col(target).cast("double").alias(target),
                                  *[F.col(c).cast("double").alias(c) for c in feature_cols if c != target]), "cv")
    edges = fold_dates(rows, k)
    day = F.col("Datetime")

    def fit(start: dt.date):
        return lambda: gbt_fit(rows.where(day < F.lit(start)), feature_cols, target, params, with_levels=with_levels)
    models = _in_pools([fit(start) for start, _ in edges])
    scored = None
    for f, (model, (start, end)) in enumerate(zip(models, edges)):
        test = rows.where(day >= F.lit(start))
        test = test if end is None else test.where(day < F.lit(end))
        part = gbt_predict(model, test).select("symbol", F.lit(f).alias("fold"), "Datetime",
                                               F.col(target).alias("y"), F.col("prediction").alias("p"))
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:                       # fewer days than folds: no split
        scored = rows.limit(0).select("symbol", F.lit(0).alias("fold"), "Datetime", F.col(target).alias("y"),
                                      F.lit(0.0).alias("p"))
    tests = scored.groupBy("symbol", "fold").agg(
        F.min("Datetime").alias("test_start"), F.max("Datetime").alias("test_end"),
        mae(F.col("y"), F.col("p")).alias("MAE"), rmse(F.col("y"), F.col("p")).alias("RMSE"),
        mape(F.col("y"), F.col("p")).alias("MAPE"))
    ends = F.array(*[F.struct(F.lit(f).alias("fold"), F.max(F.when(day < F.lit(start), day)).alias("train_end"))
                     for f, (start, _) in enumerate(edges)]) if edges else \
        F.array().cast("array<struct<fold:int,train_end:date>>")
    trains = (rows.groupBy("symbol").agg(F.min(day).alias("train_start"), ends.alias("_e"))
              .select("symbol", "train_start", F.inline("_e")).where("train_end IS NOT NULL"))
    return trains.join(tests, ["symbol", "fold"], "full").select(
        "symbol", "fold", "train_start", "train_end", "test_start", "test_end", "MAE", "RMSE", "MAPE")


def cross_validate(features: DataFrame, model_name: str = "linear", k: int = 5,
                   feature_cols: list[str] | None = None, target: str = "Close",
                   params: dict | None = None, with_levels: bool = True) -> DataFrame:
    """Expanding-window CV: fold bounds and MAE / RMSE / MAPE per (symbol, fold).

    A series too short for the split has one row with a null fold (linear). Boosted
    folds are cut by date over all series and fitted at once.
    """
    known_model(model_name)
    from daycast.operators.features import feature_columns
    cols = feature_cols or feature_columns(features)
    if model_name == "linear":
        return _cv_linear(features, cols, target, k)
    return _cv_gbt(features, cols, target, k, params, with_levels)


def cross_validate_and_save(features: DataFrame, base: str, model_name: str = "linear", k: int = 5,
                            feature_cols: list[str] | None = None, params: dict | None = None,
                            as_of: dt.date | None = None) -> DataFrame:
    """Cross-validate, store the metrics, then fit on all rows and store that model.

    Returns the stored metrics."""
    from daycast.operators.features import feature_columns
    from daycast.sources.io import sink_cv_metrics
    spark = features.sparkSession
    cols = feature_cols or feature_columns(features)
    sink_cv_metrics(cross_validate(features, model_name, k, cols, params=params), f"{base}/cv/{model_name}")
    if model_name == "linear":
        save_coefficients(ols_fit(features, cols), f"{base}/model=linear", cols)
    else:
        save_model(gbt_fit(features, cols, params=params, as_of=as_of), spark, f"{base}/model={model_name}")
    return spark.read.parquet(f"{base}/cv/{model_name}")
