"""Registration of queries, and SQL assembly for their check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from comptoir.registry.views import VIEW_SQL, VIEW_USES

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the named views (and the views they read) as common table expressions."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for used in VIEW_USES.get(name, ()):
            visit(used)
        if name not in needed:
            needed.append(name)

    for view in views:
        visit(view)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Registered(name, run, with_views(sql, *views) if sql else None)
        return run

    return add
