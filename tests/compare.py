"""Rows of a query and of its SQL, side by side."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connect(d):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{d}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return c


def both(spark, d, query, sql):
    """(columns and sorted rows) of either."""
    df = query(spark, d)
    cols = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    found = connect(d).sql(sql)
    own = sorted(found.columns)
    names = ", ".join(f'"{c}"' for c in own)
    theirs = sorted((tuple(map(plain, r)) for r in connect(d).sql(f"select {names} from ({sql})").fetchall()), key=repr)
    return (cols, mine), (own, theirs)
