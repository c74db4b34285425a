"""Tables: schema checks, scans, and writes that replace, append, merge or delete by key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def has_column(rows: DataFrame, name: str) -> bool:
    return name in rows.columns


def or_null(rows: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a null of its type where the table has none."""
    return (F.col(name) if name in rows.columns else F.lit(None).cast(kind)).alias(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def text_columns(rows: DataFrame, preferred: tuple[str, ...] = ("text_semantic", "text_sintaksis", "text_norm", "detailed_decription", "text")) -> list[str]:
    """String columns, those of a preferred name first in that order, then by name."""
    names = [c for c, t in rows.dtypes if t == "string"]
    return [p for p in preferred if p in names] + sorted(c for c in names if c not in preferred)


def join_candidates(tables: dict[str, DataFrame], key: str) -> list[str]:
    """Names of the tables that have the key and some text column."""
    return sorted(n for n, t in tables.items() if key in t.columns and text_columns(t.drop(key)))


def scan(rows: DataFrame, columns: list[str] | None = None, ts: str | None = None, start: str | None = None, end: str | None = None, equal: dict | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Chosen columns of rows from `start` to the end of the day `end`, with equal values, in order and up to a limit where given."""
    if ts and start:
        rows = rows.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if ts and end:
        day_after = (dt.date.fromisoformat(end) + dt.timedelta(days=1)).isoformat()
        rows = rows.where(F.col(ts) < F.lit(day_after).cast("timestamp"))
    for c, v in (equal or {}).items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    if order:
        rows = rows.orderBy(*order)
    rows = rows if limit is None else rows.limit(limit)
    return rows.select(*columns) if columns else rows


def latest_run(runs: DataFrame, run: str, time: str) -> DataFrame:
    """One row: the run of the greatest time (ties: the greater run)."""
    return runs.agg(F.max_by(run, F.struct(time, run)).alias(run))


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` without the rows of any key combination in `new`, and all of `new`. Keys may be null."""
    return _without(existing, new, keys).unionByName(new)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """As `replace_by_key`, with one row of `new` for each key: the first in `order`."""
    if order is None:
        order = [F.col(c) for c in new.columns if c not in keys]
    one = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return _without(existing, one, keys).unionByName(one)


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`existing`, and the rows of `new` whose key it lacks."""
    return existing.unionByName(_without(new, existing, keys))


def update_latest(existing: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The latest row of each key in `new` takes the place of the latest one in `existing`; older ones stay; absent keys are added."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last()))
    ranked = existing.withColumn("_r", rank)
    same = _without(ranked.where("_r = 1"), new, keys).drop("_r")
    return ranked.where("_r > 1").drop("_r").unionByName(same).unionByName(new)


def delete_by_key(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return _without(existing, gone, keys)


def _without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    right = other.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(right[f"_{k}"])
    return rows.join(right, same, "left_anti")


def write_replacing(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_appending(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write only the partitions that `rows` has, each as a whole; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; with `bom`, the first column's name begins with a byte order mark."""
    if bom and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    rows.write.mode("overwrite").option("header", True).csv(path)
