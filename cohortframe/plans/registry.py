"""Collects the registered queries of all parts of the library, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PARTS = ("filter_queries", "interval_queries", "join_queries", "aggregate_queries", "window_queries", "qc_queries", "report_queries", "set_queries", "source_queries")


def _parts() -> list:
    return [importlib.import_module(f"{__package__}.{name}") for name in PARTS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _parts() for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, (_, sql) in part.QUERIES.items() if sql}
