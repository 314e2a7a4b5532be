"""Registry of the queries and of the SQL that states each one independently.

Keys begin with the ids of the operator inventory. A query takes ``(spark, sf_dir)`` and returns a DataFrame over whole
tables; its SQL, where SQL can state it, gives the same columns and rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


from patquarry.plans import queries_core, queries_decided, queries_files, queries_linked, queries_misc, queries_more, queries_reports, queries_topics  # noqa: E402, F401
