"""Registered queries: a Spark job per key and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import Catalog
from .model_sql import with_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SHARED_SQL: dict[str, str] = {}


def shared_view(name: str, sql: str) -> None:
    """A derived view several oracle queries use."""
    SHARED_SQL[name] = sql


def query(key: str, sql: str | None = None):
    def register(job: Callable[[Catalog], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: job(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = sql
        return job

    return register


def oracle() -> dict[str, str]:
    return {key: with_model(sql, SHARED_SQL) for key, sql in ORACLE.items()}
