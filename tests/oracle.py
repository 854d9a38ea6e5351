"""Compare a Spark result with the SQL of the same query run by DuckDB."""
from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(problem or None, row count)"""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    expected = rel.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}", len(got)
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, expected)
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}; {[x for x in a if x not in b][:2]} {[x for x in b if x not in a][:2]}", len(got)
    for x, y in zip(a, b):
        if x != y:
            return f"{x} <> {y}", len(got)
    types = {d[0]: str(d[1]).upper() for d in rel.description}
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = {n: (types[n], spark_types[n]) for n in names if not _same_type(types[n], spark_types[n])}
    return (f"types {odd}" if odd else None), len(got)


def _same_type(duck: str, spark: str) -> bool:
    pairs = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",)}
    return duck in pairs.get(spark, (duck,)) or spark.startswith("array") or spark == "timestamp"
