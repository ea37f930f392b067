"""Forecasts of a boosted-tree model fitted once.

* ``recursive_forecast_gbt`` — the fitted trees become flat arrays walked by index,
  and ``rollout.py`` rolls all series and scenarios forward in one job; there is no
  job per day, and the plan does not grow with the trees.
* ``direct_forecast_gbt`` — the horizon as a feature: one model of
  Close[t+h] over (inputs of t, h), one pass to score all horizons.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daycast.operators import features as feat
from daycast.operators import models as md
from daycast.operators import rollout
from daycast.operators.forecast import training_frame


def recursive_forecast_gbt(model: md.TreeModel, features: DataFrame, horizon: int, as_of: dt.date,
                           cal: list[dt.date], window: int = 1095, scenarios: int = 1,
                           noise_scale: float = 0.0, seed: int = 42, causal: bool = True) -> DataFrame:
    """(symbol, scenario, h, target_date, prediction) for h = 1..horizon.

    ``features`` is the as-is table; ``causal`` must be the set the model was
    fitted on.
    """
    md.known_features(md.fitted(model), feat.feature_columns(features))
    rows = rollout.state(features, window, as_of)
    extra = md.LEVEL_COLS if model.levels is not None else []
    if extra:
        rows = rows.join(model.levels, "symbol", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in extra})
    return rollout.roll(rows, rollout.trees(features.sparkSession, model.pipeline.stages[-1], extra), model.features,
                        horizon, as_of, cal, causal, noise_scale, seed, scenarios=scenarios)


HORIZON_COL = "horizon_days"


def direct_pairs(features: DataFrame, horizons: list[int], as_of: dt.date, window: int = 1095) -> DataFrame:
    """Training rows of the direct form: causal inputs of a day, with h and the
    Close h rows later (rows whose target lies beyond as_of are left out)."""
    tw = training_frame(features, window, as_of)
    w = Window.partitionBy("symbol").orderBy("Datetime")
    later = F.array(*[F.struct(F.lit(float(h)).alias("h"), F.lead("Close", h - 1).over(w).alias("y"))
                      for h in horizons])
    return (tw.withColumn("_l", later).withColumn("_l", F.explode("_l"))
            .withColumns({HORIZON_COL: F.col("_l.h"), "Close": F.col("_l.y")})
            .where("Close IS NOT NULL").drop("_l"))


def direct_forecast_gbt(features: DataFrame, horizons: list[int], as_of: dt.date, cal: list[dt.date],
                        window: int = 1095, params: dict | None = None, cols: list[str] | None = None,
                        with_levels: bool = True) -> DataFrame:
    """(symbol, h, target_date, prediction): one model with the horizon as a feature, besides
    the inputs ``cols`` (default: all)."""
    cols = [*(feat.feature_columns(features) if cols is None else cols), HORIZON_COL]
    model = md.gbt_fit(direct_pairs(features, horizons, as_of, window), cols, params=params, with_levels=with_levels)
    rows = rollout.next_day(rollout.state(features, window, as_of), cols[:-1], as_of, cal)
    asked = rows.withColumn(HORIZON_COL, F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    h = F.col(HORIZON_COL).cast("int")
    return md.gbt_predict(model, asked).select("symbol", h.alias("h"), F.date_add(F.lit(as_of), h).alias("target_date"),
                                               "prediction")
