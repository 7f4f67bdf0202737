"""Queries of a module with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects a module's queries; ``ctes`` can be named in the SQL as ``{name}``."""

    def __init__(self, ctes: dict[str, str] | None = None):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}
        self.ctes = ctes or {}

    def __call__(self, sql: str | None = None, uses: str = "", recursive: bool = False, whole: str = "") -> Callable[[Query], Query]:
        """``whole`` names sums that DuckDB widens to 128 bits and Spark does not."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                with_ = ", ".join(self.ctes[u].strip() for u in uses.split())
                head = "WITH " + ("RECURSIVE " if recursive else "")
                text = sql.strip()
                if with_:
                    text = head + with_ + (", " + text[5:].removeprefix("RECURSIVE ") if text.upper().startswith("WITH ") else " " + text)
                if whole:
                    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in whole.split())
                    text = f"SELECT * REPLACE ({casts}) FROM ({text})"
                self.oracles[f.__name__] = text
            return f

        return add
