"""Holds a query's rows against its SQL, as multisets of values by column name."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def compare(spark, sf_dir, query, sql):
    """(rows only in Spark, rows only in SQL, number of rows)."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = connect(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols, (names, cols)
    order = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[k]) for k in order) for r in rel.fetchall())
    return list((got - want).items())[:3], list((want - got).items())[:3], sum(got.values())
