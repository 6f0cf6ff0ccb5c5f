"""Registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("q_windows", "q_frames", "q_aggregates", "q_scalar", "q_index", "q_metrics", "q_spatial", "q_more", "q_sources")


def _modules() -> list:
    import importlib

    return [importlib.import_module(f"zonalyx.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
