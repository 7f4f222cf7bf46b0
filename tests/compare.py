"""Compare a query with its SQL: names, rows, values."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _key(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_key(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.itertuples(index=False))


def same(query, sql, spark, folder):
    found, wanted = query(spark, folder).toPandas(), connection(folder).execute(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
