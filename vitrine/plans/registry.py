"""Named queries: a Spark plan plus, where SQL can express it, a DuckDB oracle.

A query is a function ``(spark, sf_dir) -> DataFrame`` that reads the driver's
tables under ``sf_dir`` (through the derived catalogue views) and runs one
operator of the catalogue over them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from vitrine.plans.views_sql import VIEW_SQL


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    views: tuple[str, ...] = field(default_factory=tuple)
    ids: tuple[str, ...] = field(default_factory=tuple)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return with_views(self.sql, self.views)


QUERIES: dict[str, Query] = {}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the catalogue views it reads, as CTEs.

    ``sql`` may itself start with ``WITH``; its CTEs are appended after the views.
    """
    ctes = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in views]
    body = sql.strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH":
        own = body[4:].lstrip()
        recursive = own[:9].upper() == "RECURSIVE"
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + ",\n" + own[9 * recursive:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body


def register(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = (),
             ids: tuple[str, ...] = ()):
    """Decorator registering a query builder under ``name``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(views), tuple(ids))
        return fn
    return deco
