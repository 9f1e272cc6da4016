"""Runs a registered query and its SQL side by side and says where they differ."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_value, row)) for row in df.itertuples(index=False)), key=repr)


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | float | np.number):
        return int(v) if float(v).is_integer() else round(float(v), 6)
    return str(v) if hasattr(v, "year") else v



def difference(spark, query, sql: str, sf_dir: str) -> str | None:
    got = query(spark, sf_dir).toPandas()
    want = connection(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = _plain(got), _plain(want)
    if a == b:
        return None
    one, two = set(a), set(b)
    only = [r for r in a if r not in two][:3], [r for r in b if r not in one][:3]
    return f"{len(a)} and {len(b)} rows; only ours {only[0]}; only SQL {only[1]}"
