"""Comparison of a Spark result with DuckDB's on the same tables."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        db.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return db


def rows(df: pd.DataFrame):
    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        if hasattr(x, "isoformat"):
            return str(pd.Timestamp(x))
        return repr(float(x)) if "float" in type(x).__name__ else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))
