"""Every query with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return add


def _load() -> None:
    import importlib

    for module in ("market", "news", "models", "trading", "stores", "streams"):
        importlib.import_module(f"barflow.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(sorted(_QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(_ORACLE.items()))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barflow.plans.market import feature_target_matrix

    return feature_target_matrix(spark, sf_dir)
