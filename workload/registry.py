"""Query registration shared by the workload modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Area:
    """A group of named queries, each with the SQL it must equal (none where SQL cannot say it)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            key = name or fn.__name__
            self.queries[key] = fn
            if sql is not None:
                self.oracles[key] = sql
            return fn
        return register


def rd(x: str | Column, places: int = 6) -> Column:
    """Rounded for comparison with SQL; sums of doubles differ in their last digits."""
    return F.round(F.col(x) if isinstance(x, str) else x, places)
