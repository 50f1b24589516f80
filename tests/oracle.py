"""Runs a query and its SQL twin on the same tables and compares the rows."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if v != v:
            return "nan"
        return repr(v + 0.0)
    return None if v is None else str(v)


def compare(df, con, sql: str) -> str | None:
    """None if rows agree, else what differs."""
    cols = sorted(df.columns)
    got = sorted([tuple(_cell(r[c]) for c in cols) for r in df.collect()], key=str)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted([tuple(_cell(r[i]) for i in at) for r in rel.fetchall()], key=str)
    spark_types = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}: {spark_types[c]} / {types[c]}" for c in cols if same.get(spark_types[c]) != types[c]]
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows against {len(want)}; only here {extra}; only there {missing}; {cols}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, as {bad[0][0]} against {bad[0][1]} {cols}; types {odd}"
    if odd:
        return f"types {odd}"
    return None
