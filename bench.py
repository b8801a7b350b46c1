"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma separated).
Every query runs once to warm up and then BENCH_RUNS times (default 2); the best time counts.
All rows are produced and thrown away.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

import pyspark

from threatloom.queries import QUERIES
from threatloom.session import build_session

HEADLINE = (
    "dedup_first", "coverage_pivot", "extract_blocks", "extract_functions_lines", "hash_embed", "knn_topk",
    "knn_blocks", "enrich_matches", "upsert_by_id", "range_first", "dedup_key", "keyword_match", "json_fallback",
    "findings_rows", "severity_summary", "limit_per_group", "corpus_build", "threat_ingest", "scan_findings",
    "stream_ingest",
)


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g",
        # the test tables are so small that stages would otherwise be merged below the number of cores
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(min(timed(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(sf.group(1)) if sf else None,
        "cpus": int(cpus),
        "spark": pyspark.__version__,
    }))


if __name__ == "__main__":
    main()
