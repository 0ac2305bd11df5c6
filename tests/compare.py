"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def differences(df, relation) -> str:
    """What differs between a Spark and a DuckDB result; empty if nothing does."""
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} and {sorted(relation.columns)}"

    def rows(found, columns):
        at = [columns.index(n) for n in names]
        return sorted((repr(tuple(r[i] for i in at)) for r in found))

    ours, theirs = rows(df.collect(), df.columns), rows(relation.fetchall(), relation.columns)
    if ours == theirs:
        return ""
    return f"{len(ours)} and {len(theirs)} rows; only ours {[r for r in ours if r not in set(theirs)][:2]}; only theirs {[r for r in theirs if r not in set(ours)][:2]}"
