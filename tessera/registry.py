"""All registered queries of the library, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from tessera.queries import (  # noqa: E402, F401
    activity,
    archived,
    crawling,
    detection,
    graphs,
    hitting,
    merges,
    ranking,
    relational,
    searching,
    siting,
    smaller,
    sourcing,
    stored,
    streams,
    texts,
)
