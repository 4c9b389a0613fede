"""Registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spendweave.catalog.views import Tables, present

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``, with the SQL that must give the same rows."""

    def wrap(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return present(build(Tables(spark, folder)))

        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return build

    return wrap
