"""How query modules register what they offer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions.numeric import round6

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = sql
            return query

        return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns to six decimals, for results that engines sum in different orders."""
    return df.withColumns({c: round6(F.col(c)) for c in columns})
