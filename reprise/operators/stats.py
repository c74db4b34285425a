"""Aggregates behind the reports: trends, tops, distributions, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def monthly_trend(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """(month, n) from the first month to the last, months without rows counting 0."""
    counts = rows.where(F.col(ts).isNotNull()).groupBy(F.trunc(F.col(ts).cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def top_values(rows: DataFrame, column: str, n: int, blank: str | None = None) -> DataFrame:
    """(value, n) of the most frequent values; blanks are dropped, or named `blank`. Ties go to the lesser value."""
    v = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    kept = rows.select((F.coalesce(v, F.lit(blank)) if blank else v).alias("value")).where("value IS NOT NULL")
    return kept.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def equal_width_bins(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) over `bins` right-closed bins of equal width from least to greatest; the first holds the least too. All bins are listed."""
    ends = rows.agg(F.min(column).cast("double").alias("_a"), F.max(column).cast("double").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    k = F.when(width <= 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col(column) - F.col("_a")) / width).cast("int"))))
    counts = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def unit_histogram(rows: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) over `bins` bins of [0, 1], the last one closed; values above 1 by rounding count as 1, others outside are left out."""
    v = F.least(F.col(column), F.lit(1.0))
    k = F.least(F.width_bucket(v, F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return rows.where((F.col(column) >= 0) & (F.col(column) <= 1 + 1e-9)).groupBy(k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def distribution(rows: DataFrame, column: str, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """n, min, max, mean, population std and exact quantiles of a column, in one row."""
    qs = [F.percentile(column, F.lit(p)).alias(f"q{round(p * 100)}") for p in probabilities]
    return rows.agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), *qs)


def cluster_summary(members: DataFrame, keys: list[str], span: Column) -> DataFrame:
    """Size, first and last time and `span` (over columns min_time and max_time) of each cluster."""
    per = members.groupBy(*keys).agg(F.count("*").alias("cluster_size"), F.min("ts").alias("min_time"), F.max("ts").alias("max_time"))
    return per.withColumn("span_days", span)


def size_distribution(sizes: DataFrame, size: str = "n") -> DataFrame:
    """Clusters, singletons, their share, largest, median, p95 and the share of rows in the ten largest clusters."""
    top = sizes.select(size).orderBy(F.desc(size)).limit(10).agg(F.coalesce(F.sum(size), F.lit(0)).alias("t"))
    per = sizes.agg(F.count("*").alias("n_clusters"), F.count_if(F.col(size) == 1).alias("n_singletons"), F.max(size).alias("max_size"), F.median(size).alias("median_size"), F.percentile(size, F.lit(0.95)).alias("p95_size"), F.sum(size).alias("s"))
    return per.crossJoin(F.broadcast(top)).select("n_clusters", "n_singletons", F.try_divide("n_singletons", "n_clusters").alias("singleton_share"), "max_size", "median_size", "p95_size", F.try_divide("t", "s").alias("top10_share"))


def bucket_trend(rows: DataFrame, unit: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Counts by day, week (from Monday) or month, and by `keys`."""
    return rows.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).cast("date").alias("bucket"), *keys).agg(F.count("*").alias("n"))


def recurrence_by_buckets(rows: DataFrame, unit: str, keys: list[str], min_buckets: int = 2, ts: str = "ts") -> DataFrame:
    """First and last time, active buckets, fractional span and recurring flag of each cluster."""
    t = F.col(ts)
    per = rows.where(t.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(t).alias("first_ts"), F.max(t).alias("last_ts"), F.countDistinct(F.date_trunc(unit, ts)).alias("active_buckets"))
    days = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 86_400_000_000
    return per.withColumn("span_days", days).withColumn("is_recurring", (F.col("active_buckets") >= min_buckets).cast("int"))


def episode_intervals(sessions: DataFrame, keys: list[str], top: int = 30) -> DataFrame:
    """Start, end, size, mid-point and square-root size of each episode of the `top` largest clusters (ties: lesser keys)."""
    largest = sessions.groupBy(*keys).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), *keys).limit(top).drop("_n")
    kept = sessions.join(F.broadcast(largest), keys)
    per = kept.groupBy(*keys, "temporal_cluster_no").agg(F.min("ts").cast("timestamp").alias("start_ts"), F.max("ts").cast("timestamp").alias("end_ts"), F.count("*").alias("size"))
    mid = F.timestamp_micros(((F.unix_micros("start_ts") + F.unix_micros("end_ts")) / 2).cast("long"))
    return per.withColumn("mid_ts", mid).withColumn("size_scaled", F.sqrt("size"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in `order`."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def gap_statistics(sessions: DataFrame) -> DataFrame:
    """n, mean, median and p90 of the known gaps of recurrent tickets."""
    gaps = sessions.where("label_berulang = 1 AND gap_days IS NOT NULL")
    return gaps.agg(F.count("*").alias("n"), F.avg("gap_days").alias("mean"), F.median("gap_days").alias("median"), F.percentile("gap_days", F.lit(0.9)).alias("p90"))


def with_lag_difference(rows: DataFrame, column: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """`rows` with delta: the difference to the row before, by `order`, within `keys`."""
    w = W.partitionBy(*(keys or [])).orderBy(order)
    return rows.withColumn("delta", F.col(column) - F.lag(column).over(w))
