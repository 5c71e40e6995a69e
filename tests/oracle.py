"""Compare a query's rows with DuckDB's on the same tables."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql, con):
    """Empty if names and rows agree; else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if got == want:
        return ""
    close = len(got) == len(want) and all(all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1, abs(a))) for a, b in zip(x, y)) for x, y in zip(got, want))
    bad = [(x, y) for x, y in zip(got, want) if x != y][:2]
    return f"{'close' if close else 'UNLIKE'}: {len(got)} rows, {len(want)} wanted; {bad}"
