"""Compare a query with its SQL on the same tables."""

import glob
import math

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for f in glob.glob(f"{sf}/*.parquet"):
        name = f.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return repr(v)


def difference(spark, con, sf, f, sql):
    """None if columns, row counts and values agree, else what differs."""
    df = f(spark, sf)
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = sorted(tuple(normal(r[c]) for c in order) for r in got)
    at = [names.index(c) for c in order]
    b = sorted(tuple(normal(r[i]) for i in at) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sum(p != q for p, q in zip(a, b))} rows differ, first {x} and {y}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    have = dict(df.dtypes)
    wrong = [f"{d[0]} {have[d[0]]} and {d[1]}" for d in cur.description if kinds.get(str(d[1]), have[d[0]]) != have[d[0]]]
    return f"types {wrong}" if wrong else None
