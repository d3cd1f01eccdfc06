"""A book of registered queries: name, plan and, where SQL can express it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views


class Book(dict):
    def add(self, name: str, plan: Callable[[Views], DataFrame], sql: str | None = None) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Views(spark, sf_dir))

        assert name not in self, name
        self[name] = (run, with_views(sql) if sql else None)
