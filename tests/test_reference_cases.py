"""The two scenarios the original test suite runs, on driver data.

1. Linear recursive forecast: horizon 365, training window 1095, refit every
   day; the features must hold no NaN and every prediction must be finite.
2. Boosted trees: 50 trees, depth 3, learning rate 0.1, fitted and scored
   in-sample; predictions written to Parquet and read back.
"""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daycast.functions.values import assert_no_nan
from daycast.operators import features as feat
from daycast.operators import forecast as fc
from daycast.operators import models as md
from daycast.plans import common
from daycast.sources import io
from conftest import SMALL

AS_OF = dt.date(2001, 8, 1)


@pytest.mark.parametrize("causal", [True, False])
def test_linear_recursive_forecast_365_days(spark, causal):
    ft = feat.feature_table(common.bars(spark, SMALL), common.calendar())
    assert_no_nan(ft)
    one = ft.where(F.col("symbol") == "3-MEDIUM")
    out = fc.recursive_forecast_ols(one, 365, AS_OF, common.calendar(), window=1095,
                                    causal=causal).toPandas()
    assert len(out) == 365
    assert np.isfinite(out["prediction"]).all()
    assert out["target_date"].min() == AS_OF + dt.timedelta(days=1)
    assert out["target_date"].max() == AS_OF + dt.timedelta(days=365)


def test_boosted_trees_in_sample(spark, tmp_dir):
    ft = feat.feature_table(common.bars(spark, SMALL), common.calendar())
    cols = feat.feature_columns(ft)
    model = md.gbt_fit(ft, cols, params=md.GBT_TEST_PARAMS)
    pred = md.gbt_predict(model, ft).select("symbol", "Datetime", "Close", "prediction")
    io.sink_predictions(pred, f"{tmp_dir}/pred")
    back = spark.read.parquet(f"{tmp_dir}/pred").toPandas()
    assert len(back) == ft.count()
    err = np.mean(np.abs(back["Close"] - back["prediction"]))
    assert err < np.mean(np.abs(back["Close"] - back["Close"].mean())) / 2
