"""Compare every registered query with its SQL twin.

    python -m registry.check [sf_dir] [name ...]
"""

from __future__ import annotations

import numbers
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and x != x):
        return "NULL"
    if type(x).__name__ == "NAType":
        return "NULL"
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    if isinstance(x, numbers.Number):
        return f"{float(x):.6f}".replace("-0.000000", "0.000000")
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in r) for r in frame[cols].astype(object).values)


def compare(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str:
    """Empty if equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(duck_frame.columns)}"
    a, b = rows(spark_frame), rows(duck_frame)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else ""


def main(argv: list[str]) -> int:
    from registry import round_trips  # noqa: F401
    from registry.queries import ORACLES, QUERIES
    from supportlake.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "check")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:28s} {len(got):7d} {spent:6.1f}s", flush=True)
                continue
            start = time.time()
            diff = compare(got, con.execute(ORACLES[name]).df())
            bad += bool(diff)
            print(
                f"{'BAD ' if diff else 'ok  '}  {name:28s} {len(got):7d} {spent:6.1f}s "
                f"{time.time() - start:5.1f}s {diff[:600]}",
                flush=True,
            )
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name:28s} {str(e)[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
