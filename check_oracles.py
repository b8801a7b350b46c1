"""Run queries against their SQL in DuckDB: python check_oracles.py [sf_dir] [query ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from threatloom.queries import ORACLES, QUERIES
from threatloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    frame = QUERIES[name](spark, sf_dir)
    ours = bag(frame.columns, map(tuple, frame.collect()))
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    theirs = bag(columns, result.fetchall())
    if ours == theirs:
        return None if ours else "no rows"
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} vs {sum(theirs.values())} rows; "
        f"ours only {sum(only_ours.values())} {list(only_ours)[:2]}; "
        f"SQL only {sum(only_theirs.values())} {list(only_theirs)[:2]}"
    )


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
