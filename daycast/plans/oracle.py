"""DuckDB twins of the registered queries (the correctness oracle).

The SQL is assembled from the same fixed parameter lists as the Spark
operators (window sizes, lags, calendar), so both sides always agree on
*what* is computed; they share no execution code.
"""

from __future__ import annotations

import datetime as dt

from daycast.functions.calendar import POST_EVENT_DAYS
from daycast.operators import features as feat
from daycast.plans import common

DIGITS = common.DIGITS


def r(expr: str, digits: int = DIGITS) -> str:
    """Round a double like the Spark side; ``+ 0.0`` folds -0.0 into 0.0."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def q(name: str) -> str:
    return f'"{name}"'


def date_lit(d: dt.date) -> str:
    return f"DATE '{d.isoformat()}'"


# --- inputs -----------------------------------------------------------------

TICKS_CTE = """ticks AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS ts, CAST(o_orderkey AS BIGINT) AS seq,
         CAST(o_totalprice AS DOUBLE) AS px, CAST(1.0 AS DOUBLE) AS vol
  FROM orders)"""

BARS_CTE = TICKS_CTE + """,
bars AS (
  SELECT symbol, CAST(ts AS DATE) AS "Date",
         arg_min(px, struct_pack(t := ts, s := seq)) AS "Open",
         max(px) AS "High", min(px) AS "Low",
         arg_max(px, struct_pack(t := ts, s := seq)) AS "Close",
         coalesce(sum(vol), CAST(0 AS DOUBLE)) AS "Volume"
  FROM ticks GROUP BY symbol, CAST(ts AS DATE))"""

W = 'PARTITION BY symbol ORDER BY "Date"'


def roll(n: int, order: str = '"Date"') -> str:
    return f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def calendar_cte(dates: list[dt.date]) -> str:
    values = ", ".join(f"({date_lit(d)})" for d in sorted(dates))
    return f"cal(e) AS (VALUES {values})"


# --- feature expressions ------------------------------------------------------

def lag_sql(c: str, n: int) -> str:
    return f"lag({q(c)}, {n}) OVER ({W})"


def mean_sql(c: str, n: int) -> str:
    return f"CASE WHEN count({q(c)}) OVER {roll(n)} = {n} THEN avg({q(c)}) OVER {roll(n)} END"


def std_sql(c: str, n: int) -> str:
    return (f"CASE WHEN count({q(c)}) OVER {roll(n)} = {n} "
            f"THEN stddev_samp({q(c)}) OVER {roll(n)} END")


def return_sql(c: str, n: int) -> str:
    return f"{q(c)} / nullif(lag({q(c)}, {n}) OVER ({W}), 0) - 1"


def event_sql(name: str) -> str:
    d = '"Date"'
    return {
        "halving_event": f"CAST(CASE WHEN {d} IN (SELECT e FROM cal) THEN 1 ELSE 0 END AS INTEGER)",
        "days_since_last_halving":
            f"CAST(coalesce((SELECT min({d} - e) FROM cal WHERE e <= {d}), 0) AS BIGINT)",
        "days_until_next_halving":
            f"CAST(coalesce((SELECT min(e - {d}) FROM cal WHERE e >= {d}), 0) AS BIGINT)",
        "halving_cycle": f"CAST((SELECT count(*) FROM cal WHERE e <= {d}) AS BIGINT)",
        "post_halving_flag":
            f"CAST(CASE WHEN EXISTS (SELECT 1 FROM cal WHERE {d} - e BETWEEN 0 AND "
            f"{POST_EVENT_DAYS}) THEN 1 ELSE 0 END AS BIGINT)",
    }[name]


def window_feature_sql() -> dict[str, str]:
    out = {}
    for c in feat.BAR_COLS:
        for n in feat.LAGS:
            out[f"{c}_lag_{n}"] = lag_sql(c, n)
    for c in feat.PRICE_COLS:
        for n in feat.MA_WINDOWS:
            out[f"{c}_ma_{n}"] = mean_sql(c, n)
    for c in feat.PRICE_COLS:
        for n in feat.STD_WINDOWS:
            out[f"{c}_std_{n}"] = std_sql(c, n)
    for c in feat.PRICE_COLS:
        for n in feat.RETURN_PERIODS:
            out[f"{c}_return_{n}"] = return_sql(c, n)
    s, l_ = feat.MOMENTUM
    for c in feat.PRICE_COLS:
        out[f"{c}_momentum_{s}_{l_}"] = f"({mean_sql(c, s)}) - ({mean_sql(c, l_)})"
    for n in feat.VOLUME_WINDOWS:
        out[f"Volume_ma_{n}"] = mean_sql("Volume", n)
        out[f"Volume_std_{n}"] = std_sql("Volume", n)
    return out


def derived_sql() -> dict[str, str]:
    return {"hl_range": '"High" - "Low"', "candle_body": '"Close" - "Open"',
            "log_volume": 'ln("Volume" + 1)'}


def fill(expr: str) -> str:
    return f"coalesce(CAST(({expr}) AS DOUBLE), CAST(0 AS DOUBLE))"


def feature_table_exprs(filled: bool = True) -> dict[str, str]:
    """Column name → SQL over ``bars`` (+ ``cal``), reference order."""
    f = fill if filled else (lambda e: f"CAST(({e}) AS DOUBLE)")
    cols = {"symbol": "symbol", "Datetime": '"Date"'}
    for c in feat.BAR_COLS:
        cols[c] = f(q(c))
    cols["trend"] = f"CAST(row_number() OVER ({W}) - 1 AS DOUBLE)"
    cols["weekday"] = 'CAST(isodow("Date") AS INTEGER)'
    cols["month"] = 'CAST(month("Date") AS INTEGER)'
    for name in feat.EVENT_COLS:
        cols[name] = event_sql(name) if name == "halving_event" else f(event_sql(name))
    for name, e in window_feature_sql().items():
        cols[name] = f(e)
    for name, e in derived_sql().items():
        cols[name] = f(e)
    return cols


def select_rounded(exprs: dict[str, str], doubles: set[str]) -> str:
    parts = []
    for name, e in exprs.items():
        parts.append(f"{r(e) if name in doubles else e} AS {q(name)}")
    return ",\n  ".join(parts)


def feature_doubles() -> set[str]:
    return {n for n in feature_table_exprs() if n not in
            ("symbol", "Datetime", "weekday", "month", "halving_event")}


def features_cte(filled: bool = True, bars_cte: str = BARS_CTE) -> str:
    """``features`` CTE (unrounded) on top of bars and the calendar."""
    exprs = feature_table_exprs(filled)
    body = ",\n    ".join(f"{e} AS {q(n)}" for n, e in exprs.items())
    return (f"{bars_cte},\n{calendar_cte(common.calendar())},\n"
            f"features AS (\n  SELECT\n    {body}\n  FROM bars)")
