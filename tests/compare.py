"""Runs a query and its SQL on one folder of tables and compares all rows."""

import glob
import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def differences(df, sql, con):
    """None if the rows are equal, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows_of(names, found.fetchall())
    got = rows_of(df.columns, [[v.asDict(True) if hasattr(v, "asDict") else [w.asDict(True) if hasattr(w, "asDict") else w for w in v] if isinstance(v, list) else v for v in r] for r in df.collect()])
    if got == want:
        return None
    extra, missing = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; only here {extra}; only in SQL {missing}"
