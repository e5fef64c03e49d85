"""Runs a registered query and its SQL twin and compares them value by value."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v else "0.0"
    return repr(v) if not isinstance(v, str) else v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(tuple(_plain(r[i]) for i in order) for r in rows))


def spark_result(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return canonical(cols, cur.fetchall())


def difference(got, want, show=4):
    """None when equal, else a short description."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    a, b = set(got[1]), set(want[1])
    return (f"rows {len(got[1])} vs {len(want[1])}; only spark "
            f"{sorted(a - b)[:show]}; only sql {sorted(b - a)[:show]}")
