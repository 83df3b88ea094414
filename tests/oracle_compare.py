"""Runs registered queries beside their DuckDB counterparts and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v + 0.0, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in rows), key=repr)


def same(spark_df, con, sql) -> str:
    """An empty string if both give the same rows, else what differs."""
    ours = cells([tuple(r) for r in spark_df.collect()], spark_df.columns)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs = cells(got.fetchall(), names)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b)):
            return f"{a} against {b}"
    return ""
