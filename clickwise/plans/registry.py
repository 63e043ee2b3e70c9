"""Registry of named queries with their oracle SQL.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with the
equivalent DuckDB SQL over the same parquet tables (None when SQL cannot
express the operator).  Timestamps leave queries as epoch-ms longs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)
