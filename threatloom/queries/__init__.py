"""Every operator as a query over the driver's tables, each with the SQL that gives the same rows.

The tables hold no C code and no CVEs, so `standins` derives some from them; a
stand-in is defined once, in expressions both Spark SQL and DuckDB read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threatloom.queries import findings, snippets, state, threats, vectors

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (snippets, threats, findings, vectors, state)

QUERIES: dict[str, Query] = {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}
ORACLES: dict[str, str] = {
    name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql is not None
}
