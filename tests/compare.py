"""Rows of a query and of its SQL, in one form, sorted."""

import math
from pathlib import Path

import duckdb


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted(tuple(str(plain(v[i])) for i in order) for v in values)


def from_spark(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def from_sql(sql, sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return sorted(columns), rows(columns, cur.fetchall())
