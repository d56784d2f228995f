"""The register of queries and of the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.binding import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_BUILT: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, build: Callable[[SparkSession, str], object]) -> object:
    """What `build` makes of some tables, made once in a session: an index or a store that several queries read."""
    key = (spark.sparkContext.applicationId, build, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = build(spark, sf_dir)
    return _BUILT[key]


def query(sql: str | None = None, bound: bool = True):
    """Register a function under its name; `sql` follows the common tables of the binding, as further ones or a SELECT."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = f"{SQL.strip()}{'' if body.startswith(',') else ' '}{body}" if bound else body
        return f

    return add
