"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import base

MODULES = ["grid_queries", "window_queries", "metric_queries", "event_queries", "model_queries", "recipes", "store_queries", "report_queries", "desk_queries", "chain_queries"]

for _name in MODULES:
    import_module(f"tidemark.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["latched_reversion_performance"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
