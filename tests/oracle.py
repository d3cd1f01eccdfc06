"""Runs a query and its SQL side by side and compares rows, regardless of their order."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df) -> list[tuple]:
    names = sorted(df.columns)

    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        try:
            return f"{float(x):.6g}" if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[names].itertuples(index=False, name=None))


def compare(spark, name: str, folder: str, queries: dict, sql: dict) -> int:
    got = queries[name](spark, folder).toPandas()
    if name not in sql:
        return len(got)
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    want = c.execute(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)
