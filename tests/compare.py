"""Row-by-row comparison of a Spark result with the SQL text run in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, v)
    if isinstance(v, (int, float)):
        return (2, float(v))
    return (3, str(v))


def difference(df, con, sql: str) -> str | None:
    """None if equal: same column names, same multiset of rows; else what differs first."""
    names = sorted(df.columns)
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    if sorted(theirs) != names:
        return f"columns {names} vs {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    right = sorted(tuple(_cell(row[i]) for i in order) for row in result.fetchall())
    left = sorted(tuple(_cell(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).toLocalIterator())
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}; e.g. {left[:2]} vs {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"{dict(zip(names, a))} vs {dict(zip(names, b))}"
    return None
