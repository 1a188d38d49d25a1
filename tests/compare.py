"""Spark result against DuckDB result, order aside."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def assert_same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())
    assert got == want
