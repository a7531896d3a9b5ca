"""Rows of a Spark DataFrame against rows of SQL in DuckDB over the same Parquet files."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def compare(df, sql: str, sf_dir: str) -> None:
    rel = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    cols = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not bad, (cols, len(bad), bad[:3])
