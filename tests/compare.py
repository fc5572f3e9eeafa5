"""Run a query and its SQL side by side: rows, column names and values must agree."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short report."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} != {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in names]
    kinds = {n: t for n, t in df.dtypes}
    want = {"bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    types = [
        f"{c}: {kinds[c]} vs {rel.types[i]}" for c, i in zip(names, order)
        if str(rel.types[i]) != want.get(kinds[c], kinds[c])
    ]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in rel.fetchall())
    ours = Counter(tuple(plain(row[c]) for c in names) for row in df.select(*[f"`{c}`" for c in names]).collect())
    if ours != theirs:
        a, b = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"{names}: {sum(ours.values())} vs {sum(theirs.values())} rows; only ours {a}; only sql {b}"
    return f"types {types}" if types else None
