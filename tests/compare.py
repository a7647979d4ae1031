"""Row-for-row comparison of a Spark query with its SQL, whatever the order of rows and columns."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings clara_full clara_track clara_era5_merged clara_hourly_by_grid clara_monthly_summary covariate_summary fold_assignments mix_targets".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def plain(x):
    """Values of either engine in one form; numbers of equal value are equal whatever their width."""
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else float(f"{x:.12g}")
    if isinstance(x, int):
        return float(f"{x:.17g}") if abs(x) < 2**53 else x
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "item"):
        return plain(x.item())
    try:
        return float(x)  # decimals
    except (TypeError, ValueError):
        return str(x)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str, show: int = 3) -> list[str]:
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want, got = rows_of(names, rel.fetchall()), rows_of(df.columns, df.collect())
    out = []
    if sorted(n.lower() for n in names) != sorted(c.lower() for c in df.columns):
        out.append(f"columns {sorted(df.columns)} against {sorted(names)}")
    if len(want) != len(got):
        out.append(f"{len(got)} rows against {len(want)}")
    a, b = set(got), set(want)
    if a != b:
        out.append(f"only Spark: {sorted(a - b, key=repr)[:show]}; only SQL: {sorted(b - a, key=repr)[:show]}")
    return out
