"""Compares a query's rows with its SQL's rows on the tables of a folder."""

import duckdb

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def same_rows(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    compare(df, con, sql)


def compare(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda row: [(v is None, str(v)) for v in row]
    want = sorted((list(r) for r in got.fetchall()), key=order)
    assert sorted(([r[n] for n in names] for r in df.collect()), key=order) == want
    assert want
