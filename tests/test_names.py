"""Names that queries use exist: an import clean-up cannot break one unseen."""
import ast
import builtins
import importlib
import pkgutil

import pytest

import daycast
from daycast.plans import registry

MODULES = [m.name for m in pkgutil.walk_packages(daycast.__path__, "daycast.")
           if not m.name.startswith("daycast.llm")]

# The queries of the daily-series part; one that goes missing is noticed.
KEYS = set("""
assert_no_nan calendar_parts check_epoch_unit compare_models cross_validate cross_validate_causal cross_validate_gbt
cross_validate_lags cross_validate_stump csv_daily_ohlcv cv_trend_ols daily_ohlcv daily_range_volume day_metrics days_since_event
days_until_event derived_ohlcv direct_forecast direct_forecast_as_of direct_forecast_gbt direct_forecast_stump epoch_to_ts event_cycle
event_flag days_since_event_table days_until_event_table event_cycle_table event_flag_table
post_event_flag_table expanding_folds feature_table fill_missing forecast_table forecast_vs_actual gbt_fit_predict gbt_stump
get_current incremental_features is_stale is_stale_series lag_n latest_per_target list_runs merge_current model_report
model_report_monthly momentum needs_forecast needs_forecast_models ols_fit_lags ols_fit_predict
ols_fit_predict_causal overlay_history_forecast period_return post_event_flag price_history recursive_forecast_ar
recursive_forecast_ar_as_of recursive_forecast_gbt recursive_forecast_lags recursive_forecast_ols
recursive_forecast_ols_once recursive_refit_lags replace_run rolling_mean rolling_std runs_as_text scenario_forecast scenario_forecast_calm direct_forecast_year stream_daily_ohlcv
train_window train_window_as_of trend_index upsert_run volume_rolling
""".split())


@pytest.mark.parametrize("name", MODULES)
def test_names_resolve(name):
    module = importlib.import_module(name)
    tree = ast.parse(open(module.__file__).read())
    for node in ast.walk(tree):
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            held = getattr(module, node.value.id, None)
            if isinstance(held, type(ast)) and held.__name__.startswith("daycast"):
                assert hasattr(held, node.attr), f"{name}: {node.value.id}.{node.attr} (line {node.lineno})"
        elif isinstance(node, ast.ImportFrom) and (node.module or "").startswith("daycast"):
            source = importlib.import_module(node.module)
            for alias in node.names:
                assert hasattr(source, alias.name) or importlib.import_module(f"{node.module}.{alias.name}")
    bound = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load)}
    bound |= {a.arg for n in ast.walk(tree) if isinstance(n, ast.arguments)
              for a in [*n.args, *n.kwonlyargs, *n.posonlyargs, n.vararg, n.kwarg] if a}
    bound |= {(a.asname or a.name).split(".")[0] for n in ast.walk(tree)
              if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    bound |= {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.ClassDef))}
    bound |= {n.name for n in ast.walk(tree) if isinstance(n, ast.ExceptHandler) and n.name}
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            assert node.id in bound or hasattr(builtins, node.id) or hasattr(module, node.id), \
                f"{name}: {node.id} (line {node.lineno})"


def test_no_query_is_lost():
    assert KEYS <= set(registry.queries())
