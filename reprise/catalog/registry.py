"""Registration of queries, and the tables that stand in for ticket data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its DuckDB SQL where there is one."""
    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tickets: the customer is the cluster, the order date the submit time."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("incident_id"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("site"), F.col("o_orderpriority").alias("modul"), F.col("o_totalprice").alias("price")
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as ticket texts: the language is the site, the source the module."""
    return load(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("site"), F.col("source").alias("modul"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tickets of sub-day times: the user is the cluster, the type the module."""
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("incident_id"), F.col("user_id").alias("cluster_id"), "ts", F.col("event_type").alias("modul"), "value", "props")


#: The same stand-ins as DuckDB common table expressions.
TICKETS = "t AS (SELECT o_orderkey AS incident_id, o_custkey AS cluster_id, o_orderdate AS ts, o_orderstatus AS site, o_orderpriority AS modul, o_totalprice AS price FROM orders)"
TEXTS = "x AS (SELECT doc_id, text, lang AS site, source AS modul FROM documents)"
ACTIVITY = "a AS (SELECT event_id AS incident_id, user_id AS cluster_id, ts, event_type AS modul, value, props FROM events)"
