"""Registry of named queries: a Spark builder and, where SQL can express
it, a DuckDB oracle text over the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ids: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn

    return deco
