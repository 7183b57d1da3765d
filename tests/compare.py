"""Registered query against its SQL counterpart on the same tables."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 9)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_cell(r[i]) for i in order)) for r in rows)


def differences(spark, con, sf_dir, name, query, sql):
    """Empty when columns, types in broad terms, and all rows agree."""
    started = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    spark_time = time.time() - started
    started = time.time()
    rel = con.sql(sql)
    want = rel.fetchall()
    sql_time = time.time() - started
    out = []
    if sorted(df.columns) != sorted(rel.columns):
        out.append(f"columns {sorted(df.columns)} != {sorted(rel.columns)}")
    else:
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
        sql_types = dict(zip(rel.columns, map(str, rel.types)))
        for c, t in df.dtypes:
            if kinds.get(t) != sql_types[c]:
                out.append(f"type of {c}: {t} / {sql_types[c]}")
        a, b = _rows(df.columns, got), _rows(rel.columns, want)
        if a != b:
            left, right = set(a) - set(b), set(b) - set(a)
            out.append(f"rows {len(a)} / {len(b)}; e.g. {sorted(left)[:1]} / {sorted(right)[:1]}"[:1500])
    return out, len(got), spark_time, sql_time
