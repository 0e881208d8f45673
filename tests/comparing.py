"""Rows of Spark and DuckDB in one form, so that they can be compared."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x: object) -> str:
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return str([plain(y) for y in x])
    if pd.isna(x):
        return "null"
    if isinstance(x, float) and x == int(x):
        return str(int(x))
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(df.columns)
    return sorted(tuple(plain(x) for x in r) for r in df[names].astype(object).itertuples(index=False))


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()
