"""Recursive forecasts of a model fitted once.

Spark reduces a series to one row: arrays of its last ``TAIL`` bars, its trend and its
maxima. The rows, not the histories, are mapped: a task takes its rows, makes the
scenarios of each, and rolls all of them forward in step, day by day, by the rules of
``recursion.py``. A model is a function of the paths' input matrix: a dot product with
per-series coefficients, or fitted trees as flat arrays walked by index, so a plan has
the same size for any number of trees, days and scenarios.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daycast.functions.values import greatest_nan_safe
from daycast.operators import features as feat
from daycast.operators import recursion as rec
from daycast.operators.windowing import train_window

TAIL = max(feat.RETURN_PERIODS) + 1      # bars the longest look-back needs
BLOCK = 128                              # scenarios of a series that one row stands for
PATHS = 1024                             # paths rolled in step, at most


def state(features: DataFrame, window: int, as_of: dt.date) -> DataFrame:
    """One row per symbol: bar arrays up to as_of, trend, maxima over the window."""
    tw = train_window(features, window, order="Datetime", as_of=as_of)
    ranked = tw.withColumn("_rk", F.row_number().over(
        Window.partitionBy("symbol").orderBy(F.col("Datetime").desc())))
    bars = F.struct("Datetime", *[F.col(c).cast("double").alias(c) for c in feat.BAR_COLS])
    agg = ranked.groupBy("symbol").agg(
        F.max("trend").cast("double").alias("trend"),
        F.max(greatest_nan_safe([F.col(c) for c in feat.PRICE_COLS], rec.MIN_PRICE)).cast("double").alias("max_price"),
        F.max("Volume").cast("double").alias("max_volume"),
        F.sort_array(F.collect_list(F.when(F.col("_rk") <= TAIL, bars))).alias("_bars"))
    return agg.select("symbol", F.xxhash64("symbol").alias("series_key"), "trend", "max_price", "max_volume",
                      *[F.expr(f"transform(_bars, b -> b.`{c}`)").alias(c) for c in feat.BAR_COLS])


STATE_COLS = ["symbol", "series_key", "trend", "max_price", "max_volume", *feat.BAR_COLS]


@dataclass
class Predictor:
    """A model over input matrices: ``predict(x, columns)`` for paths x inputs, with the
    named columns of their rows (arrays as matrices)."""

    predict: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]
    columns: list[str]


def linear() -> Predictor:
    """Rows hold ``intercept`` and ``coef``."""
    return Predictor(lambda x, row: row["intercept"] + np.einsum("ij,ij->i", x, row["coef"]), ["intercept", "coef"])


@dataclass
class Forest:
    """Fitted trees as flat arrays: node n sends a row with ``x[feature[n]] <= threshold[n]``
    to ``left[n]``, others to ``right[n]``; a leaf (feature -1) holds its value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        at = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[node]
            lower = x[at, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(feature < 0, node, np.where(lower, self.left[node], self.right[node]))
        return self.value[node] @ self.weights


def flat_trees(model) -> Forest:
    """Arrays of a fitted boosted-tree model, from its printed splits."""
    nodes: list[list] = []          # feature, threshold, left, right, value
    roots, depth = [], 0
    for fitted in model.trees:
        lines = iter([ln.strip() for ln in fitted.toDebugString.splitlines()[1:] if ln.strip()])

        def node() -> int:
            ln, n = next(lines), len(nodes)
            nodes.append([-1, 0.0, n, n, 0.0])
            if ln.startswith("Predict:"):
                nodes[n][4] = float(ln.split(":")[1])
                return n
            m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", ln)
            if not m:
                raise ValueError(f"not a split on a number: {ln}")
            nodes[n][0], nodes[n][1] = int(m[1]), float(m[2])
            nodes[n][2] = node()
            next(lines)                                   # the matching Else
            nodes[n][3] = node()
            return n
        roots.append(node())
        depth = max(depth, fitted.depth)
    feature, threshold, left, right, value = zip(*nodes) if nodes else [()] * 5
    return Forest(np.array(feature, np.int32), np.array(threshold, float), np.array(left, np.int32),
                  np.array(right, np.int32), np.array(value, float), np.array(roots, np.int32),
                  np.array(model.treeWeights, float), depth)


def trees(spark, model, extra: list[str]) -> Predictor:
    """A fitted boosted-tree model; ``extra`` are inputs that are columns of the row."""
    sent = spark.sparkContext.broadcast(flat_trees(model))     # bounded by the model's settings
    return Predictor(lambda x, row: sent.value(np.column_stack([x, *[row[c] for c in extra]])), list(extra))


def _column(table: pa.Table, name: str) -> np.ndarray:
    """A column as an array, lists of one length as a matrix."""
    column = table[name].combine_chunks()
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _alike(table: pa.Table) -> list[pa.Table]:
    """Rows with as many bars each (most series have ``TAIL``)."""
    sizes = table["Close"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    return [table.filter(pa.array(sizes == n)) for n in np.unique(sizes)]


def make_paths(table: pa.Table, horizon: int, cal: list[dt.date], causal: bool) -> rec.Paths:
    """Paths of the rows of one length."""
    return rec.Paths({c: _column(table, c).astype(float) for c in feat.BAR_COLS},
                     *[_column(table, c) for c in ("trend", "max_price", "max_volume")], horizon, cal, causal)


PATH_SCHEMA = "symbol string, scenario int, h int, target_date date, prediction double"
_PATH = pa.schema([("symbol", pa.string()), ("scenario", pa.int32()), ("h", pa.int32()),
                   ("target_date", pa.date32()), ("prediction", pa.float64())])


def roll_table(table: pa.Table, predictor: Predictor, cols: list[str], horizon: int, as_of: dt.date,
               cal: list[dt.date], causal: bool, noise: float, seed: int, clip: bool) -> pa.RecordBatch:
    """All days of the paths of ``table``: rows of one length, one per path."""
    paths = make_paths(table, horizon, cal, causal)
    columns = {c: _column(table, c) for c in predictor.columns}
    key, scenario = _column(table, "series_key"), _column(table, "scenario")
    ceiling = np.maximum(paths.max_price, rec.PRICE_CEILING_FLOOR)
    out = np.empty((table.num_rows, horizon))
    for k in range(horizon):
        z = {c: rec.standard_normal(seed, key, scenario, k + 1, n) for n, c in enumerate(feat.BAR_COLS)} \
            if noise else None
        bar = paths.carried_bar(z, noise)
        x = paths.matrix(paths.inputs(as_of + dt.timedelta(days=k + 1), bar), cols)
        y = predictor.predict(x, columns)
        out[:, k] = np.minimum(np.maximum(y, rec.MIN_PRICE), ceiling) if clip else y
        paths.append(bar, out[:, k])
    n = table.num_rows
    each = pa.array(np.repeat(np.arange(n), horizon))
    days = pa.array([as_of + dt.timedelta(days=h + 1) for h in range(horizon)], pa.date32())
    return pa.RecordBatch.from_arrays(
        [table["symbol"].combine_chunks().take(each).cast(pa.string()), pa.array(np.repeat(scenario, horizon), pa.int32()),
         pa.array(np.tile(np.arange(1, horizon + 1), n), pa.int32()),
         days.take(pa.array(np.tile(np.arange(horizon), n))), pa.array(out.ravel())], schema=_PATH)


def roll(rows: DataFrame, predictor: Predictor, cols: list[str], horizon: int, as_of: dt.date,
         cal: list[dt.date], causal: bool = True, noise_scale: float = 0.0, seed: int = 42,
         clip: bool = False, scenarios: int = 1) -> DataFrame:
    """(symbol, scenario, h, target_date, prediction) for the days after as_of.

    ``rows`` is ``state`` with whatever columns the predictor reads. ``clip`` keeps
    predictions in the price range of the history.
    """
    def run(batches):
        for b in batches:
            whole = pa.Table.from_batches([b])
            for table in _alike(whole):
                times = np.minimum(BLOCK, scenarios - _column(table, "first"))
                each = np.repeat(np.arange(table.num_rows), times)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                for s in range(0, len(each), PATHS):
                    at = each[s:s + PATHS]
                    part = table.take(pa.array(at))
                    number = _column(part, "first") + nth[s:s + PATHS]
                    yield roll_table(part.append_column("scenario", pa.array(number, pa.int32())), predictor,
                                     cols, horizon, as_of, cal, causal, noise_scale, seed, clip)
    first = F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1), F.lit(BLOCK))).alias("first")
    rows = rows.select(*STATE_COLS, *predictor.columns, first)
    if scenarios > BLOCK:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "first")
    return rows.mapInArrow(run, PATH_SCHEMA)


def next_day(rows: DataFrame, cols: list[str], as_of: dt.date, cal: list[dt.date],
             causal: bool = True) -> DataFrame:
    """The model inputs of the day after as_of, one row per series."""
    def run(batches):
        for b in batches:
            for table in _alike(pa.Table.from_batches([b])):
                paths = make_paths(table, 1, cal, causal)
                x = paths.matrix(paths.inputs(as_of + dt.timedelta(days=1), paths.carried_bar()), cols)
                yield pa.RecordBatch.from_arrays([table["symbol"].combine_chunks(), pa.array(list(x))],
                                                 names=["symbol", "x"])
    out = rows.select(*STATE_COLS).mapInArrow(run, "symbol string, x array<double>")
    return out.select("symbol", *[F.col("x")[k].alias(c) for k, c in enumerate(cols)])
