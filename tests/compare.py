"""Runs a query beside its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def same(df, con, sql: str) -> None:
    got, want = df.toPandas(), con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    rows = [sorted(map(tuple, x[columns].astype(object).where(x[columns].notna(), None).astype(str).itertuples(index=False))) for x in (got, want)]
    differ = [(a, b) for a, b in zip(*rows, strict=True) if a != b]
    assert not differ, differ[:3]
