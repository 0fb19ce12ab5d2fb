"""Hold a Spark result against DuckDB SQL over the same Parquet tables: columns sorted by name, rows in any order."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            path = f"{path}/*.parquet" if glob.glob(f"{path}/*.parquet") else path
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in rows]
    return sorted(out, key=repr)


def differences(df, sql: str, sf_dir: str, con=None) -> list[str]:
    """What differs; empty when equal."""
    con = con or connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = plain(cur.fetchall(), names)
    mine = plain(df.collect(), df.columns)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    if len(mine) != len(theirs):
        return [f"rows {len(mine)} / {len(theirs)}"]
    return [f"{sorted(names)}: {a} / {b}" for a, b in zip(mine, theirs, strict=True) if a != b][:3]
