"""Side-by-side check of a Spark query against its DuckDB oracle.

Used by the tests and by ``scripts/check_oracles.py``; it mirrors the
driver's gate: row count, column names, and an order-insensitive hash of
the values (columns sorted by name, floats compared at 1e-9 relative).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, _dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return v.isoformat()
    if isinstance(v, (_dt.date, _dt.time)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
    return h.hexdigest(), lines


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out = {
        "rows_spark": len(s_rows),
        "rows_oracle": len(d_rows),
        "rows_match": len(s_rows) == len(d_rows),
        "schema_match": sorted(s_cols) == sorted(d_cols),
    }
    if not out["schema_match"]:
        out["only_spark"] = sorted(set(s_cols) - set(d_cols))
        out["only_oracle"] = sorted(set(d_cols) - set(s_cols))
        out["values_match"] = False
        return out
    hs, ls = _digest(s_cols, s_rows)
    hd, ld = _digest(d_cols, d_rows)
    out["values_match"] = hs == hd
    if hs != hd:
        diff_s = sorted(set(ls) - set(ld))[:3]
        diff_d = sorted(set(ld) - set(ls))[:3]
        out["sample_spark_only"] = diff_s
        out["sample_oracle_only"] = diff_d
        out["columns"] = sorted(s_cols)
    return out
