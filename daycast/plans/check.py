"""Compare a registered Spark query with its DuckDB oracle.

Mirrors the correctness gate: same column names, row count, type family,
and the order-free multiset of rows.
"""

from __future__ import annotations

import math
from collections import Counter

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duckdb_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _family(t: str) -> str:
    t = t.lower()
    if any(k in t for k in ("double", "float", "real")):
        return "float"
    if any(k in t for k in ("bigint", "long", "int64")):
        return "int64"
    if any(k in t for k in ("int", "short", "byte")):
        return "int32"
    if "timestamp" in t:
        return "timestamp"
    if "date" in t:
        return "date"
    if any(k in t for k in ("string", "varchar", "utf8")):
        return "string"
    if "bool" in t:
        return "bool"
    if "decimal" in t:
        return "decimal"
    return t


def compare(spark_df, con, sql: str, show: int = 3) -> dict:
    s_rows = [tuple(r) for r in spark_df.collect()]
    s_cols = spark_df.columns
    s_types = [_family(f.dataType.simpleString()) for f in spark_df.schema.fields]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [_family(str(t)) for t in rel.types]
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows)}
    if sorted(s_cols) != sorted(d_cols):
        out["columns"] = (sorted(s_cols), sorted(d_cols))
        out["ok"] = False
        return out
    order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    st = [s_types[i] for i in order_s]
    dtp = [d_types[i] for i in order_d]
    if st != dtp:
        out["types"] = [(s_cols[i], a, b) for i, a, b in
                        zip(order_s, st, dtp) if a != b]
    cs = Counter(tuple(_norm(r[i]) for i in order_s) for r in s_rows)
    cd = Counter(tuple(_norm(r[i]) for i in order_d) for r in d_rows)
    only_s = cs - cd
    only_d = cd - cs
    out["mismatch"] = sum(only_s.values()) + sum(only_d.values())
    if out["mismatch"]:
        names = [s_cols[i] for i in order_s]
        out["example_spark"] = [dict(zip(names, r)) for r in list(only_s)[:show]]
        out["example_oracle"] = [dict(zip(names, r)) for r in list(only_d)[:show]]
    out["ok"] = out["mismatch"] == 0 and len(s_rows) == len(d_rows) and "types" not in out
    return out
