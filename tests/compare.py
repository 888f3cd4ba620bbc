"""Compare a Spark query with its DuckDB SQL on the same tables."""

import math
import os

import duckdb

DATA = os.environ.get("MARROW_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data=DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        if hasattr(v, "as_tuple"):
            v = float(v)
        if isinstance(v, float):
            v = round(v, 9)
            return int(v) if v == int(v) else v
        return str(v) if isinstance(v, list) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


def check(spark, con, query, sql, data=DATA):
    df = query(spark, data)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = plain(tuple(r[i] for i in at) for r in cur.fetchall())
    assert got == want
    return len(got)
