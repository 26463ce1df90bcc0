"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.operators.scoring import DIGITS
from priorline.plans.views import SQL

Query = Callable[[SparkSession, str], DataFrame]


def with_views(body: str, more: str = "") -> str:
    """``body`` over the views of games, reports and lines, and further common table expressions."""
    return f"with recursive {SQL.strip()}{', ' + more.strip() if more else ''} {body.strip()}"


def rounded(name: str) -> Column:
    return F.round(F.col(name), DIGITS).alias(name)


class Registry:
    """The queries of a module, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, body: str | None = None, more: str = "") -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if body:
                self.sql[f.__name__] = with_views(body, more)
            return f

        return add
