"""Registered queries: a function of (spark, sf_dir), and its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .standins import table, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._dir, name)


def query(*tables: str, sql: str | None = None):
    """Register the decorated function of Tables under its name; sql may use the derived tables named."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = (with_sql(*tables) + ",\n" + sql.strip()[5:] if sql.strip().lower().startswith("with ") else with_sql(*tables) + "\n" + sql) if tables else sql
        return f

    return add
