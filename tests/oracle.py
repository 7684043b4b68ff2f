"""Runs registered queries and their checking SQL side by side."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        r = round(float(value), 5)
        return 0.0 if r == 0 else r
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    return value


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple(str(x) for x in t))


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-5 + 1e-9 * abs(b)
    return type(a) is type(b) and a == b


def compare(df, con, sql: str) -> str:
    """'' when equal, else a short account of the difference."""
    got_cols, got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = canon([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = [g for g in got if g not in set(want)][:2]
        missing = [w for w in want if w not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; extra {extra}; missing {missing}"
    for g, w in zip(got, want):
        if not all(close(a, b) for a, b in zip(g, w)):
            return f"{got_cols}\n   got {g}\n  want {w}"
    return "" if got else "EMPTY"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from spanloom.session import local_session

    folder = "/root/testdata/sf0.01"
    names = sys.argv[1:]
    spark, con, sqls, bad = local_session(), duck(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                msg = compare(fn(spark, folder), con, sqls[name])
            else:
                n = len(fn(spark, folder).collect())
                msg = "" if n else "EMPTY"
        except Exception as exc:  # noqa: BLE001 - report and go on
            msg = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(msg)
        print(f"{'ok ' if not msg else 'BAD'} {name} {time.time() - t0:.1f}s {'' if name in sqls else '(rows only)'} {msg}", flush=True)
    print("bad:", bad)
