"""Compares queries with their SQL on the same tables: row count, columns, values in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return str(x)


def mismatch(spark, name: str, query, sql: str, sf: str) -> str:
    """Empty if both agree."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = query(spark, sf)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(got.columns):
        return f"{name}: columns {sorted(got.columns)} and {sorted(names)}"
    rows = got.select(*names).collect()
    a, b = Counter(tuple(map(_plain, r)) for r in rows), Counter(tuple(map(_plain, r)) for r in want)
    if a == b:
        return ""
    return f"{name}: {len(rows)} and {len(want)} rows; only query {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
