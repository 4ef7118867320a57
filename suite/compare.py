"""Run a query and its SQL side by side and compare the rows, whatever their order."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return format(float(value), ".9g")
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(_plain(row[i]) + ("\0" if row[i] is None else "") for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf):
    """None where both agree, else a short account of the difference."""
    df = query(spark, sf)
    mine = _rows(df.columns, df.collect())
    answer = con.sql(sql)
    theirs = _rows(answer.columns, answer.fetchall())
    if mine[0] != theirs[0]:
        return f"{name}: columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        extra = [r for r in mine[1] if r not in set(theirs[1])][:2]
        lacking = [r for r in theirs[1] if r not in set(mine[1])][:2]
        cut = lambda rows: [[c[:160] for c in r] for r in rows]
        return f"{name}: {len(mine[1])} and {len(theirs[1])} rows; only here {cut(extra)}; only there {cut(lacking)}"
    return None
