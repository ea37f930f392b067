"""Models and forecasts against NumPy brute force on small fixtures."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daycast.operators import features as feat
from daycast.operators import folds as fo
from daycast.operators import forecast as fc
from daycast.operators import models as md
from daycast.operators import recursion as rec
from daycast.operators import rollout
from daycast.operators import tree_forecast as tf
from daycast.plans import common
from conftest import SMALL

AS_OF = dt.date(2001, 8, 1)


@pytest.fixture(scope="module")
def features(spark):
    return feat.feature_table(common.bars(spark, SMALL), common.calendar()).cache()


def lstsq(X, y):
    """Independent solve: normal system with an intercept column, by pseudo-inverse."""
    A = np.column_stack([np.ones(len(X)), X])
    return np.linalg.pinv(A) @ y


def test_ols_matches_an_independent_solve(spark, features):
    causal = feat.causal_features(features)
    cols = ["Close_lag_1", "Close_lag_3", "Close_ma_7", "trend", "Volume"]
    pred = md.ols_predict(md.ols_fit(causal, cols), causal, cols).toPandas()
    for sym, g in causal.toPandas().groupby("symbol"):
        beta = lstsq(g[cols].to_numpy(float), g["Close"].to_numpy(float))
        want = beta[0] + g[cols].to_numpy(float) @ beta[1:]
        got = pred[pred.symbol == sym].set_index("Datetime").loc[g["Datetime"], "prediction"]
        np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-6, atol=1e-2)


def test_ols_residuals_of_all_features_are_orthogonal(spark, features):
    causal = feat.causal_features(features)
    cols = feat.feature_columns(causal)
    pred = md.ols_predict(md.ols_fit(causal, cols), causal, cols).toPandas()
    for _, g in pred.groupby("symbol"):
        X = g[cols].to_numpy(float)
        r = (g["Close"] - g["prediction"]).to_numpy()
        X = X - X.mean(axis=0)
        scale = np.linalg.norm(X, axis=0) * np.linalg.norm(r) + 1e-9
        assert np.abs(X.T @ r / scale).max() < 1e-6 and abs(r.mean()) < 1e-6 * g["Close"].mean()


@pytest.mark.parametrize("blocks", [1, 7])
def test_ols_does_not_depend_on_the_blocks(spark, blocks):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 2))
    y = 3 + X @ [2.0, -1.0]
    df = spark.createDataFrame([("a", *map(float, x), float(v)) for x, v in zip(X, y)] + [("b", 1.0, 1.0, 5.0)],
                               "symbol string, p double, q double, Close double")
    got = {r.symbol: r for r in md.ols_fit(df, ["p", "q"], blocks=blocks).collect()}
    assert got["a"].intercept == pytest.approx(3) and got["a"].coef == pytest.approx([2, -1])
    assert got["b"].intercept == pytest.approx(5) and got["b"].coef == pytest.approx([0, 0])


def test_a_series_without_coefficients_keeps_its_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("new", 1.0, None)],
                               "symbol string, x double, Close double")
    out = {r.symbol: r.prediction for r in md.ols_predict(md.ols_fit(df, ["x"]), df.where("x = 1"), ["x"]).collect()}
    assert out["a"] == pytest.approx(2) and out["new"] is None


def test_coefficients_save_load(spark, features, tmp_dir):
    cols = feat.feature_columns(features)
    coefs = md.ols_fit(features, cols)
    md.save_coefficients(coefs, f"{tmp_dir}/coef", cols)
    loaded, lcols = md.load_coefficients(spark, f"{tmp_dir}/coef")
    assert lcols == cols and loaded.count() == coefs.count()


def test_unknown_model_and_missing_feature(spark, features):
    with pytest.raises(ValueError):
        md.known_model("prophet")
    with pytest.raises(ValueError):
        md.check_model_inputs(features, ["nope"], "Close")
    with pytest.raises(ValueError, match="symbol.*not numbers"):
        md.check_model_inputs(features, ["Open", "symbol"], "Close")


MID = dt.date(1998, 1, 1)


def test_causal_next_row_is_the_tables_row_of_that_day(spark, features):
    """The row built for day d from days before equals the causal row of a table that holds d."""
    cols = feat.feature_columns(features)
    causal = feat.causal_features(features).toPandas()
    raw = features.toPandas()
    for k in (1, 2, 25, 150, 250):                    # short and full look-backs, series of other lengths
        g = raw[raw.symbol == "1-URGENT"].sort_values("Datetime").reset_index(drop=True)
        day, before = g["Datetime"][k], g["Datetime"][k - 1]
        state = rollout.state(features, 5000, before)
        got = rollout.next_day(state, cols, day - dt.timedelta(days=1), common.calendar()).toPandas().set_index("symbol")
        want = causal[causal.Datetime == day].set_index("symbol")
        assert "1-URGENT" in want.index
        for sym in want.index:
            own = raw[(raw.symbol == sym) & (raw.Datetime < day)]["Datetime"]
            for c in cols if len(own) and own.max() <= before else []:
                assert got.loc[sym, c] == pytest.approx(want.loc[sym, c], rel=1e-9, abs=1e-9), (k, sym, c)


def test_refit_and_fit_once_agree_on_the_first_day_and_with_numpy(spark, features):
    cols = feat.feature_columns(features)
    cal = common.calendar()
    one = features.where(F.col("symbol") == "1-URGENT")
    once = fc.recursive_forecast_ols(one, 3, MID, cal, 200, refit=False).toPandas()
    daily = fc.recursive_forecast_ols(one, 3, MID, cal, 200).toPandas()
    assert once["prediction"][0] == pytest.approx(daily["prediction"][0], rel=1e-5)
    # by hand: minimum-norm fit on the last 200 causal rows, applied to the next row
    g = feat.causal_features(one.where(F.col("Datetime") <= F.lit(MID))).toPandas().sort_values("Datetime")
    X, y = g[cols].to_numpy(float)[-200:], g["Close"].to_numpy(float)[-200:]
    w = np.linalg.pinv(X - X.mean(axis=0), rcond=np.finfo(float).eps * 200) @ (y - y.mean())
    row = rollout.next_day(rollout.state(one, 200, MID), cols, MID, cal).toPandas().iloc[0]
    x = row[cols].to_numpy(float)
    assert once["prediction"][0] == pytest.approx(y.mean() + (x - X.mean(axis=0)) @ w, rel=1e-5)


def test_recursion_is_not_the_carried_bar(spark, features):
    """0.9 * last + 0.1 * ma_30 is what a fit on the day's own candle gives, whatever the data."""
    out = fc.recursive_forecast_ols(features, 10, MID, common.calendar(), 500, refit=False).toPandas()
    raw = features.where(F.col("Datetime") <= F.lit(MID)).toPandas()
    for sym, g in raw.groupby("symbol"):
        c = list(g.sort_values("Datetime")["Close"])
        carried = []
        for _ in range(10):
            carried.append(0.9 * c[-1] + 0.1 * np.mean(c[-30:]))
            c.append(carried[-1])
        got = out[out.symbol == sym].sort_values("h")["prediction"].to_numpy()
        assert np.abs(got / carried - 1).max() > 1e-3


def test_scenarios_without_noise_are_the_fit_once_path(spark, features):
    cal = common.calendar()
    once = fc.recursive_forecast_ols(features, 5, MID, cal, 300, refit=False).toPandas()
    scen = fc.scenario_forecast(features, 5, MID, cal, scenarios=3, window=300, noise_scale=0.0).toPandas()
    a = once.sort_values(["symbol", "h"])["prediction"].to_numpy()
    b = scen.sort_values(["symbol", "h"])
    for c in ("p10", "p50", "p90"):
        np.testing.assert_allclose(b[c], a, rtol=1e-12)
    assert (b["paths"] == 3).all()


@pytest.mark.parametrize("op", ["direct", "ar", "once", "refit"])
def test_no_forecast_reads_past_as_of(spark, features, op):
    bars = common.bars(spark, SMALL)
    cal = common.calendar()
    run = {"direct": lambda b, f: fc.direct_forecast(b, 3, MID),
           "ar": lambda b, f: fc.recursive_forecast_ar(b, 3, MID),
           "once": lambda b, f: fc.recursive_forecast_ols(f, 3, MID, cal, refit=False),
           "refit": lambda b, f: fc.recursive_forecast_ols(f, 3, MID, cal, 100)}[op]
    cut = F.lit(MID)
    whole = run(bars, features).toPandas().sort_values(["symbol", "h"])["prediction"]
    known = run(bars.where(F.col("Date") <= cut), features.where(F.col("Datetime") <= cut)) \
        .toPandas().sort_values(["symbol", "h"])["prediction"]
    np.testing.assert_allclose(whole.to_numpy(), known.to_numpy(), rtol=1e-9)


def test_hash_noise_is_standard_normal_and_repeatable():
    path, scenario = np.full(20_000, -7), np.arange(20_000)
    z = rec.standard_normal(42, path, scenario, 3, 0)
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((z ** 3).mean()) < 0.1
    assert np.array_equal(z, rec.standard_normal(42, path, scenario, 3, 0))
    for other in (rec.standard_normal(43, path, scenario, 3, 0), rec.standard_normal(42, path + 1, scenario, 3, 0),
                  rec.standard_normal(42, path, scenario, 4, 0), rec.standard_normal(42, path, scenario, 3, 1)):
        assert abs(np.corrcoef(z, other)[0, 1]) < 0.03


def test_paths_do_not_depend_on_the_blocks(spark, features, monkeypatch):
    cal = common.calendar()
    run = lambda: fc.recursive_forecast_ols(features, 4, MID, cal, 300, scenarios=11, noise_scale=0.3, refit=False, \
                                            cols=["Open", "Close_lag_1", "Volume"], clip=False).toPandas().sort_values(["symbol", "scenario", "h"]).reset_index(drop=True)
    whole = run()
    monkeypatch.setattr(rollout, "BLOCK", 3)
    monkeypatch.setattr(rollout, "PATHS", 2)
    pd.testing.assert_frame_equal(whole, run())
    assert len(whole) == 5 * 11 * 4
    kinds = whole.groupby(["h", "symbol"])["prediction"].nunique()
    assert (kinds.loc[1] == 1).all() and (kinds.loc[2:] == 11).all()     # the first day is known but for its Close


def test_quantiles_are_within_the_stated_error(spark, features):
    cal = common.calendar()
    paths = fc.recursive_forecast_ols(features, 3, MID, cal, 300, scenarios=400, noise_scale=0.3, refit=False).toPandas()
    for accuracy in (20, 1000):
        out = fc.scenario_forecast(features, 3, MID, cal, scenarios=400, window=300, accuracy=accuracy).collect()
        assert len(out) == 15
        for r in out:
            own = np.sort(paths[(paths.symbol == r.symbol) & (paths.h == r.h)]["prediction"])
            assert r.paths == len(own) == 400
            for q, v in ((0.1, r.p10), (0.5, r.p50), (0.9, r.p90)):
                lo, hi = np.searchsorted(own, v, "left") + 1, np.searchsorted(own, v, "right")
                assert lo - len(own) / accuracy - 1 <= q * len(own) <= hi + len(own) / accuracy + 1


def plain_refit(g, window, horizon, cols, cal, as_of):
    """One series refitted on all rows of its window every day."""
    raw = g[g.Datetime <= as_of].sort_values("Datetime").reset_index(drop=True)
    X, y = raw[[f"x_{c}" for c in cols]].to_numpy(float)[-window:], raw["Close"].to_numpy(float)[-window:]
    last = raw.tail(window)
    paths = rec.Paths({c: raw[[c]].to_numpy(float).T for c in feat.BAR_COLS}, np.array([last["trend"].max()]),
                      np.array([last[feat.PRICE_COLS].to_numpy().max()]), np.array([last["Volume"].max()]), horizon, cal)
    ceiling, out = max(paths.max_price[0], rec.PRICE_CEILING_FLOOR), []
    for k in range(horizon):
        bar = paths.carried_bar()
        x = paths.matrix(paths.inputs(as_of + dt.timedelta(days=k + 1), bar), cols)
        xm, ym = X[-window:].mean(axis=0), y[-window:].mean()
        beta, *_ = np.linalg.lstsq(X[-window:] - xm, y[-window:] - ym, rcond=None)
        out.append(min(max(ym + (x[0] - xm) @ beta, rec.MIN_PRICE), ceiling))
        X, y = np.vstack([X, x]), np.append(y, out[-1])
        paths.append(bar, np.array([out[-1]]))
    return out


@pytest.mark.parametrize("window,horizon", [(120, 30), (1000, 10), (90, 120)])
def test_sliding_refit_equals_a_plain_refit(spark, features, window, horizon):
    cols = ["Close_lag_1", "Close_lag_3", "Close_ma_7", "trend", "Volume", "Close_std_30", "month"]
    cal = common.calendar()
    got = fc.recursive_forecast_ols(features, horizon, MID, cal, window, cols=cols).toPandas()
    raw = features.toPandas()
    causal = feat.causal_features(features).toPandas()[["symbol", "Datetime", *cols]]
    both = raw.merge(causal.rename(columns={c: f"x_{c}" for c in cols}), on=["symbol", "Datetime"])
    for sym, g in both.groupby("symbol"):
        want = plain_refit(g, window, horizon, cols, cal, MID)
        path = got[got.symbol == sym].sort_values("h")["prediction"]
        np.testing.assert_allclose(path, want, rtol=1e-6)


def test_flat_trees_equal_the_model_for_any_number_of_trees(spark, features):
    causal = feat.causal_features(features)
    cols = feat.feature_columns(causal)
    sizes = []
    for n in (2, 25):
        model = md.gbt_fit(causal, cols, params={"maxIter": n, "maxDepth": 4, "stepSize": 0.3, "seed": 1})
        forest = rollout.flat_trees(model.pipeline.stages[-1])
        pred = md.gbt_predict(model, causal)
        x = md._with_levels(causal, model.levels).select("symbol", "Datetime", *model.inputs).toPandas()
        want = pred.toPandas().set_index(["symbol", "Datetime"])["prediction"]
        got = pd.Series(forest(x[model.inputs].to_numpy(float)), pd.MultiIndex.from_frame(x[["symbol", "Datetime"]]))
        np.testing.assert_allclose(got.loc[want.index], want, rtol=1e-9)
        out = tf.recursive_forecast_gbt(model, features, 3, AS_OF, common.calendar())
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
    assert abs(sizes[0] - sizes[1]) < 200


def test_ar_path_is_the_recursion(spark):
    df = spark.createDataFrame([(1.0, 0.5, 10.0)], "b0 double, b1 double, y0 double")
    got = df.select(fc.ar_path(F.col("b0"), F.col("b1"), F.col("y0"), 4).alias("p")).first()["p"]
    y, want = 10.0, []
    for _ in range(4):
        y = 1.0 + 0.5 * y
        want.append(y)
    assert got == pytest.approx(want)


PARAMS = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3, "seed": 42}


def test_gbt_fit_predict_and_tree_recursion(spark, features, tmp_dir):
    causal = feat.causal_features(features)
    cols = feat.feature_columns(causal)
    model = md.train_or_load(f"{tmp_dir}/gbt", causal, cols, PARAMS)
    again = md.train_or_load(f"{tmp_dir}/gbt", causal, cols, PARAMS)   # loads
    p1 = md.gbt_predict(model, causal).select("symbol", "Datetime", "Close", "prediction").toPandas()
    p2 = md.gbt_predict(again, causal).select("symbol", "Datetime", "Close", "prediction").toPandas()
    key = ["symbol", "Datetime"]
    np.testing.assert_allclose(p1.sort_values(key)["prediction"], p2.sort_values(key)["prediction"])
    y = p1["Close"]
    assert np.mean(np.abs(y - p1["prediction"])) < np.mean(np.abs(y - y.mean()))
    out = tf.recursive_forecast_gbt(model, features, 3, AS_OF, common.calendar()).toPandas()
    assert len(out) == 15 and out["prediction"].notna().all()
    # the first day is the model's own score of the next row
    row = rollout.next_day(rollout.state(features, 1095, AS_OF), cols, AS_OF, common.calendar())
    want = md.gbt_predict(model, row).toPandas().set_index("symbol")["prediction"]
    got = out[out.h == 1].set_index("symbol")["prediction"]
    np.testing.assert_allclose(got.loc[want.index], want, rtol=1e-9)


def test_a_saved_model_of_other_features_or_settings_is_not_used(spark, features, tmp_dir):
    path = md.model_path(tmp_dir, "xgboost", "all", AS_OF)
    small = {"maxIter": 2, "maxDepth": 2, "seed": 1}
    first = md.train_or_load(path, features, ["Open", "High"], small)
    other = md.train_or_load(path, features, ["Volume_ma_7"], {**small, "maxIter": 3})
    assert first.features == ["Open", "High"] and other.features == ["Volume_ma_7"]
    assert other.pipeline.stages[-1].getNumTrees == 3
    assert md.load_model(spark, path).features == ["Volume_ma_7"]
    with pytest.raises(ValueError, match="Volume_ma_7"):
        md.gbt_predict(other, features.select("symbol", "Open"))


def test_prediction_from_a_feature_file(spark, features, tmp_dir):
    model = md.gbt_fit(features, ["Open", "High"], params={"maxIter": 2, "maxDepth": 2, "seed": 1})
    features.select("High", "symbol", "Open").write.parquet(f"{tmp_dir}/f")
    assert md.gbt_predict_file(model, spark, f"{tmp_dir}/f").count() == features.count()
    features.select("symbol", "Open").write.parquet(f"{tmp_dir}/g")
    with pytest.raises(ValueError, match="High"):
        md.gbt_predict_file(model, spark, f"{tmp_dir}/g")


def test_direct_boosted_form(spark, features):
    out = tf.direct_forecast_gbt(features, [1, 7, 30], MID, common.calendar(), 300, PARAMS).toPandas()
    assert len(out) == 15 and sorted(out["h"].unique()) == [1, 7, 30] and out["prediction"].notna().all()
    pairs = tf.direct_pairs(features, [1, 7], MID, 300).toPandas()
    raw = features.toPandas().set_index(["symbol", "Datetime"])["Close"]
    g = features.where("symbol = '2-HIGH'").toPandas().sort_values("Datetime").reset_index(drop=True)
    at = {d: i for i, d in enumerate(g["Datetime"])}
    for r in pairs[pairs.symbol == "2-HIGH"].sample(20, random_state=1).itertuples():
        assert r.Close == g["Close"][at[r.Datetime] + int(r.horizon_days) - 1]
    assert pairs["Datetime"].max() <= MID and len(raw)


def test_pooled_folds_are_cut_by_date(spark, features):
    folds = md.fold_dates(features, 3)
    days = sorted(features.select("Datetime").distinct().toPandas()["Datetime"])
    ts = len(days) // 4
    assert [f[0] for f in folds] == [days[len(days) - (3 - k) * ts] for k in range(3)]
    assert [f[1] for f in folds] == [folds[1][0], folds[2][0], None]
    assert md.fold_dates(features.limit(2), 5) == []


def test_cross_validation_ends_in_a_stored_model(spark, features, tmp_dir):
    causal = feat.causal_features(features)
    cv = md.cross_validate_and_save(causal, tmp_dir, "linear", 3, ["Close_lag_1"])
    coefs, cols = md.load_coefficients(spark, f"{tmp_dir}/model=linear")
    assert cv.count() == 15 and cols == ["Close_lag_1"] and coefs.count() == 5
    md.cross_validate_and_save(causal, tmp_dir, "xgboost", 2, ["Close_lag_1"],
                               {"maxIter": 2, "maxDepth": 2, "seed": 1}, AS_OF)
    held = md.load_model(spark, f"{tmp_dir}/model=xgboost")
    assert held.as_of == AS_OF and held.features == ["Close_lag_1"]


def test_short_series_are_reported(spark):
    rows = [("long", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i + 1), float(i)) for i in range(12)]
    rows += [("short", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "symbol string, Datetime date, Close double, x double")
    cv = md.cross_validate(df, "linear", 5, ["x"]).collect()
    assert sorted((r.symbol, -1 if r.fold is None else r.fold) for r in cv) == \
        [*(("long", f) for f in range(5)), ("short", -1)]
    bars = df.withColumnRenamed("Datetime", "Date")
    trend = {(r.symbol, r.fold): r for r in fo.cv_trend_ols(bars, 5).collect()}
    assert ("short", None) in trend and trend[("short", None)]["MAE"] is None and len(trend) == 6
    roles = fo.expanding_folds(bars, 5).where("symbol = 'short'").collect()
    assert [r.role for r in roles] == ["short"] * 3 and all(r.fold is None for r in roles)


def test_scenarios_are_seeded(spark, features):
    a = fc.scenario_forecast(features, 3, AS_OF, common.calendar(), scenarios=4, window=100)
    b = fc.scenario_forecast(features, 3, AS_OF, common.calendar(), scenarios=4, window=100)
    pa = a.orderBy("symbol", "h").toPandas()
    pb = b.orderBy("symbol", "h").toPandas()
    pd.testing.assert_frame_equal(pa, pb)
    assert (pa["p10"] <= pa["p50"]).all() and (pa["p50"] <= pa["p90"]).all()


def test_gbt_cross_validation(spark, features):
    cv = md.cross_validate(features, "xgboost", 2,
                           params={"maxIter": 3, "maxDepth": 2, "seed": 42}).collect()
    assert len(cv) == 10 and all(r["MAE"] is not None for r in cv)


def test_linear_cv_equals_numpy_prefix_fits(spark, features):
    causal = feat.causal_features(features)      # no leakage: errors are real, not ~1e-10
    cols = ["Close_lag_1", "Close_lag_3", "Close_ma_7", "trend", "Volume"]
    got = {(r["symbol"], r["fold"]): r for r in md.cross_validate(causal, "linear", 5, cols).collect()}
    pdf = causal.toPandas()
    for sym, g in pdf.groupby("symbol"):
        g = g.sort_values("Datetime")
        X, y = g[cols].to_numpy(float), g["Close"].to_numpy(float)
        n, ts = len(y), len(y) // 6
        for f in range(5):
            start = n - (5 - f) * ts
            beta = lstsq(X[:start], y[:start])
            p = beta[0] + X[start:start + ts] @ beta[1:]
            r = got[(sym, f)]
            assert r["MAE"] == pytest.approx(np.mean(np.abs(y[start:start + ts] - p)),
                                             rel=1e-5, abs=1e-9 * np.abs(y).mean())
            assert r["train_end"] == g["Datetime"].iloc[start - 1]
            assert r["test_end"] == g["Datetime"].iloc[start + ts - 1]


@pytest.mark.parametrize("key,operator", [("cross_validate_gbt", "cross_validate"),
                                          ("direct_forecast_gbt", "direct_forecast_gbt")])
def test_boosted_queries_use_the_service_settings(monkeypatch, key, operator):
    from daycast.plans import models_q
    seen = []
    monkeypatch.setattr(models_q, "_features", lambda *a, **k: None)
    monkeypatch.setattr(common, "round_doubles", lambda df, digits=0: df)
    monkeypatch.setattr(md if operator == "cross_validate" else models_q, operator,
                        lambda *a, **k: seen.extend([*a, *k.values()]))
    models_q.QUERIES[key](None, SMALL)
    assert md.GBT_SERVICE_PARAMS in seen and md.GBT_TEST_PARAMS not in seen
