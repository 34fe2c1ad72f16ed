"""Compare a query with its SQL in DuckDB over the same parquet tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted("|".join(map(cell, r)) for r in df.itertuples(index=False, name=None))


def check(spark, query, sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
