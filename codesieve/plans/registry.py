"""Registry of query builders and their oracle SQL writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
SPARK: dict[str, QueryFn] = {}
ORACLE: dict[str, Callable[[], str]] = {}

FILE_KEYS = ["repo_url", "snapshot_id", "doc_id"]


def spark_query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        SPARK[name] = fn
        return fn
    return deco


def oracle_query(name: str):
    def deco(fn: Callable[[], str]) -> Callable[[], str]:
        ORACLE[name] = fn
        return fn
    return deco
