"""Compare a registered query with its SQL twin in an in-process DuckDB."""

from __future__ import annotations

import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> list[str]:
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if got == want:
        return []
    left, right = list((got - want).elements()), list((want - got).elements())
    return [f"rows {sum(got.values())} vs {sum(want.values())}; only spark {len(left)}, only sql {len(right)}"] + [
        f"  {got_cols}", *(f"  spark {r}" for r in sorted(left, key=str)[:2]), *(f"  sql   {r}" for r in sorted(right, key=str)[:2])]
