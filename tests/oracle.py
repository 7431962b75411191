"""Side-by-side comparison of Spark queries with DuckDB SQL."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, con, sql: str) -> str | None:
    """What differs between a frame and the rows of a query, None if nothing."""
    got = df.toArrow()
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(got.column_names):
        return f"columns {sorted(got.column_names)} against {sorted(names)}"
    a = rows(got.column_names, list(zip(*[c.to_pylist() for c in got.columns])))
    b = rows(names, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} against {y}"
    return None
