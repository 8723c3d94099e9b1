"""Run registered queries next to their SQL and compare the rows as multisets.

Usage: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def value(v):
    return round(v, 9) if isinstance(v, float) else v


def differences(df, con, sql: str) -> str:
    """Empty if both sides hold the same rows under the same column names."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    expected = Counter(tuple(value(dict(zip(names, r))[c]) for c in order) for r in result.fetchall())
    found = Counter(tuple(value(r[c]) for c in order) for r in df.collect())
    if expected == found:
        return ""
    return (
        f"rows {sum(found.values())} vs {sum(expected.values())}; only Spark {list((found - expected).items())[:3]}; "
        f"only SQL {list((expected - found).items())[:3]}"
    )


def main() -> None:
    import __spark_entry__ as entry
    from opinloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(), connect(folder)
    failed = []
    for name in chosen:
        start = time.time()
        try:
            df, sql = entry.queries()[name](spark, folder), entry.oracle_sql().get(name)
            outcome = differences(df, con, sql) if sql else f"rows only: {len(df.collect())}"
        except Exception as e:  # report every query
            outcome = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if outcome and not outcome.startswith("rows only"):
            failed.append(name)
        print(f"{time.time() - start:6.1f}s {name}: {outcome[:900] or 'ok'}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
