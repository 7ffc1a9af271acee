"""Run registered queries and their SQL side by side and compare the rows.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat() if not hasattr(v, "to_pydatetime") else v.to_pydatetime().isoformat()
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    return v


def compare(spark, con, q, sf_dir: str) -> str | None:
    """None if the rows agree, else what differs."""
    got = q.run(spark, sf_dir)
    want = con.sql(q.sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    names = sorted(got.columns)
    a = sorted((tuple(_cell(r[n]) for n in names) for r in got.collect()), key=repr)
    at = [want.columns.index(n) for n in names]
    b = sorted((tuple(_cell(r[i]) for i in at) for r in want.fetchall()), key=repr)
    if a == b:
        return None
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return f"{len(a)} rows != {len(b)} rows; spark only {sorted(only_a, key=repr)[:3]}; sql only {sorted(only_b, key=repr)[:3]}"


def main(argv: list[str]) -> int:
    from plotmerge.plans import QUERIES
    from plotmerge.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    con = connection(sf_dir)
    bad = 0
    for name, q in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if q.sql is None:
                n = q.run(spark, sf_dir).count()
                print(f"rows {name} {n} ({time.time() - start:.1f}s)", flush=True)
                continue
            diff = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{'FAIL' if diff else 'ok  '} {name} {diff or ''} ({time.time() - start:.1f}s)", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
