"""The registry of queries over the library's own operators, each held against SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from reprise.catalog.registry import QUERIES, SQL

_MODULES: tuple[str, ...] = ("episodes", "profiles", "wording", "tabular", "spaces", "prediction")
for _name in _MODULES:
    import_module(f"reprise.catalog.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode table of the orders stand-in, with its recurrence label."""
    return QUERIES["LBL-01"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
