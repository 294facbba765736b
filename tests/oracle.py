"""Comparison of a named query with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import glob
import os

import duckdb

ALLOWED = {"VARCHAR", "DOUBLE", "BIGINT", "BOOLEAN"}
SPARK_KIND = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and the SQL's; None if nothing does."""
    described = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    columns = sorted(described)
    if sorted(df.columns) != columns:
        return f"columns {sorted(df.columns)} != {columns}"
    kinds = {name: SPARK_KIND.get(kind, kind) for name, kind in df.dtypes}
    wrong = {c: (kinds[c], described[c]) for c in columns if kinds[c] != described[c]}
    if wrong or not set(kinds.values()) <= ALLOWED:
        return f"types {wrong or kinds}"

    def key(row):
        return tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row)

    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    order = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(con.execute(f"SELECT {order} FROM ({sql})").fetchall(), key=key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    unequal = [(o, t) for o, t in zip(ours, theirs) if o != t]
    if unequal:
        return f"{len(unequal)} of {len(ours)} rows differ, first {columns}: {unequal[0]}"
    return None
