"""Compare a query with its DuckDB oracle: columns by name, rows in any order."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([repr(cell(r[k])) for k in order] for r in found))


def difference(df, con, sql):
    """An empty text, or what differs."""
    left = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    right = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
