"""daycast — daily time-series bars, features, folds, forecasts and a
forecast store, expressed as Spark DataFrame / SQL operators.

Every public operator takes and returns a ``DataFrame``; nothing is
collected to the driver except schema-level checks and one-row
validation aggregates.

The names below are resolved lazily, so executor Python workers that only
need one helper module do not import the whole package (ML, streaming).
"""

from importlib import import_module

_API = {
    "daycast.session": ["build_session", "checkpoint_dir", "ship_package"],
    "daycast.operators.bars": ["daily_ohlcv", "daily_range_volume", "price_history"],
    "daycast.operators.features": ["feature_table", "causal_features", "feature_columns"],
    "daycast.operators.folds": ["expanding_folds", "fold_bounds", "cv_trend_ols"],
    "daycast.operators.evaluation": ["forecast_vs_actual", "day_metrics", "metrics_for_day",
                                     "model_report"],
    "daycast.operators.forecast": ["train_window", "direct_forecast", "recursive_forecast_ar",
                                   "recursive_forecast_ols", "scenario_forecast"],
    "daycast.operators.tree_forecast": ["recursive_forecast_gbt"],
    "daycast.operators.models": ["ols_fit", "ols_predict", "gbt_fit", "gbt_predict",
                                 "train_or_load", "cross_validate"],
    "daycast.operators.store": ["latest_per_target", "merge_current", "upsert_run",
                                "replace_run", "save_run", "scan_runs", "scan_current"],
    "daycast.streaming.bars_stream": ["stream_daily_ohlcv", "incremental_features"],
}
_WHERE = {name: module for module, names in _API.items() for name in names}
__all__ = list(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(_WHERE[name]), name)
    raise AttributeError(f"module 'daycast' has no attribute {name!r}")
