"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.exprs import tidy
from ..oracles.base import compose
from .workspace import Workspace, workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = 8):
    """Register ``fn(workspace) -> DataFrame``; doubles are rounded for comparison."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (lambda ws: tidy(fn(ws), digits)) if digits is not None else fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def runnable(name: str):
    return lambda spark, sf_dir: QUERIES[name](workspace(spark, sf_dir))


def all_queries() -> dict:
    return {name: runnable(name) for name in QUERIES}


def all_oracles() -> dict[str, str]:
    return {name: compose(sql) for name, sql in ORACLES.items()}
