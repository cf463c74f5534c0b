"""Named queries over the driver tables, each with the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: QueryFn
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query. ``covers`` lists the inventory ids it answers, separated by spaces."""

    def add(fn: QueryFn) -> QueryFn:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn

    return add
