"""Filters, joins, ranks and set operations with the semantics that the reports rely on."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def identifier(name: str) -> str:
    """A name that may stand in SQL unquoted; anything else is an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def without_noise(rows: DataFrame, cluster: str = "cluster_id", null_is_noise: bool = True) -> DataFrame:
    """Rows of cluster other than -1; rows without a cluster count as noise unless told otherwise."""
    c = F.col(cluster)
    return rows.where(c != -1) if null_is_noise else rows.where(c.isNull() | (c != -1))


def not_blank(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull()


def contains_ignoring_case(c: str, part: str) -> Column:
    return F.lower(c).contains(part.lower())


def with_small_clusters_as_noise(rows: DataFrame, least: int, cluster: str = "cluster_id") -> DataFrame:
    """`rows` with cluster_size and is_recurring; clusters of fewer than `least` rows become -1."""
    n = F.count("*").over(W.partitionBy(cluster))
    rows = rows.withColumn("cluster_size", n)
    large = F.col("cluster_size") >= least
    return rows.withColumn("is_recurring", large.cast("int")).withColumn(cluster, F.when(large, F.col(cluster)).otherwise(-1))


def small_cluster_effect(rows: DataFrame, least: int, cluster: str = "cluster_id") -> DataFrame:
    """Rows and clusters before and after leaving out clusters of fewer than `least` rows."""
    per = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    kept = F.col("n") >= least
    return per.agg(F.sum("n").alias("rows_before"), F.count("*").alias("clusters_before"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("rows_after"), F.count_if(kept).alias("clusters_after"))


def number_or(c: str, default: float) -> Column:
    return F.coalesce(F.expr(f"try_cast({identifier(c)} AS double)"), F.lit(default))


def harmonized(value: Column, aliases: dict[str, str], contains: dict[str, str], default: str = "UNKNOWN") -> Column:
    """A category by exact alias, else by contained text in order, else the trimmed value in capitals; blank is `default`."""
    v = F.lower(F.trim(value))
    out = F.when(value.isNull() | (v == ""), default)
    for k, to in aliases.items():
        out = out.when(v == k.lower(), to)
    for part, to in contains.items():
        out = out.when(v.contains(part.lower()), to)
    return out.otherwise(F.upper(F.trim(value)))


def with_fallback(rows: DataFrame, facts: DataFrame, levels: list[list[str]], values: list[str]) -> DataFrame:
    """`rows` with `values` and `level`: from the facts' mean at the first level of keys that has any, else the mean over all.

    Each level is a small aggregate, joined once; level counts down from the number of levels, 0 for the overall mean.
    """
    known = None
    for i, keys in enumerate(levels):
        per = facts.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(*[F.avg(v).alias(f"_{v}{i}") for v in values], F.lit(len(levels) - i).alias(f"_l{i}"))
        rows = rows.join(per, keys, "left")
    total = facts.agg(*[F.avg(v).alias(f"_{v}_all") for v in values])
    rows = rows.crossJoin(F.broadcast(total))
    known = F.coalesce(*[F.col(f"_l{i}") for i in range(len(levels))], F.lit(0))
    out = {v: F.coalesce(*[F.when(F.col(f"_l{i}").isNotNull(), F.col(f"_{v}{i}")) for i in range(len(levels))], F.col(f"_{v}_all")) for v in values}
    rows = rows.withColumns({**out, "level": known})
    return rows.drop(*[f"_{v}{i}" for v in values for i in range(len(levels))], *[f"_l{i}" for i in range(len(levels))], *[f"_{v}_all" for v in values])


def overlap(a: DataFrame, b: DataFrame, key: str = "incident_id") -> DataFrame:
    """(cluster_a, cluster_b, n): how many keys two memberships (key, cluster) share, by pair of clusters."""
    left, right = a.select(key, F.col("cluster").alias("cluster_a")), b.select(key, F.col("cluster").alias("cluster_b"))
    return left.join(right, key).groupBy("cluster_a", "cluster_b").agg(F.count("*").alias("n"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key, in order. Spark limits each task's rows before they are shuffled."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number`, from 1, of `size` rows in order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """`n` rows in the order of a seeded hash of the key: the same draw at any partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def sample_strata(rows: DataFrame, strata: list[str], n: int, key: str, seed: int = 42) -> DataFrame:
    """At most `n` rows of each stratum, by a seeded hash of the key."""
    return first_per_key(rows, strata, [F.xxhash64(F.lit(seed), key), F.col(key)], n)


def cluster_order(cluster: str = "cluster_id") -> list[Column]:
    """Clusters ascending, noise last."""
    return [(F.col(cluster) == -1).asc(), F.col(cluster).asc_nulls_last()]
