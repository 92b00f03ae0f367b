"""Side-by-side comparison of a query with its reference SQL in DuckDB."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.10g}") + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(norm(row[k]) for k in order) for row in rows]
    return sorted(out, key=lambda t: tuple((x is not None, str(type(x)), x) for x in t)), [columns[k] for k in order]


def compare(spark, con, d, fn, sql):
    t0 = time.time()
    df = fn(spark, d)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    want, want_cols = rows_of([c[0] for c in cur.description], cur.fetchall())
    t2 = time.time()
    problem = None
    if got_cols != want_cols:
        problem = f"columns {got_cols} != {want_cols}"
    elif len(got) != len(want):
        problem = f"{len(got)} rows, want {len(want)}"
    else:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        if bad:
            problem = f"{len(bad)} of {len(got)} rows differ, first {bad[:2]} columns {got_cols}"
        else:
            kinds = {c: str(t) for c, t in df.dtypes}
            for k, c in enumerate(got_cols):
                types = {type(r[k]) for r in got if r[k] is not None} | {type(r[k]) for r in want if r[k] is not None}
                if len(types) > 1:
                    problem = f"column {c} ({kinds[c]}) has mixed types {types}"
    return problem, len(got), t1 - t0, t2 - t1
