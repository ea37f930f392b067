"""All registered queries and their SQL oracles, keyed by operator name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daycast.plans import features_q, forecast_q, models_q, store_q, streams_q

_MODULES = [features_q, store_q, forecast_q, models_q, streams_q]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.SQL)
    return {k: v for k, v in out.items() if k in queries()}
