"""A query's rows beside those of its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _shown(x):
    if hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return str(x.tolist())
    return "" if pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x)


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [_shown(int(x) if isinstance(x, float) and x.is_integer() else x) for x in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same_as_sql(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = tidy(query(spark, sf_dir).toPandas()), tidy(con.sql(sql).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)
