"""Compare registered queries with their SQL twins; also runnable by hand.

    python -m tests.oracle [sf] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/sf{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def canonical(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_cell(r[i]) for i in order) for r in rows)


def check(spark, con, entry, sf: str) -> str:
    t0 = time.time()
    df = entry.run(spark, f"{DATA}/sf{sf}")
    rows = df.collect()
    took = time.time() - t0
    if entry.sql is None:
        return f"ROWS {len(rows)} ({took:.1f}s)" if rows else "EMPTY"
    t0 = time.time()
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    duck = time.time() - t0
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    got, want = canonical(df.columns, rows), canonical(names, expected)
    if got != want:
        left = [g for g in got if g not in set(want)][:2]
        right = [w for w in want if w not in set(got)][:2]
        return f"DIFF {len(got)} vs {len(want)}\n   spark {str(left)[:700]}\n   duck  {str(right)[:700]}"
    return f"OK {len(rows)} rows (spark {took:.1f}s duck {duck:.1f}s)" if rows else "OK-EMPTY"


def main(argv: list[str]) -> None:
    from papyra.plans import load_all
    from papyra.session import local_session

    sf = argv[0] if argv else "0.001"
    spark, con = local_session(), connect(sf)
    bad = 0
    for name, entry in load_all().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            outcome = check(spark, con, entry, sf)
        except Exception as e:  # report and go on with the next query
            outcome = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += not outcome.startswith(("OK ", "ROWS"))
        print(f"{name:34s} {outcome}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
