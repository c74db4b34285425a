"""Episodes of a ticket stream, by session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_episodes(tickets: DataFrame, window_days: int, delay: str = "30 days", keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """(keys, first_date, last_date, n) of episodes: dates at most window_days apart belong to one, as in the batch operator.

    A session ends once the watermark passes it; tickets later than `delay` are left out. Works on static tables as well.
    """
    dated = tickets.withColumn("_day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    if dated.isStreaming:
        dated = dated.withWatermark("_day", delay)
    per = dated.groupBy(*keys, F.session_window("_day", f"{window_days} days").alias("_w"))
    return per.agg(F.min("_day").cast("date").alias("first_date"), F.max("_day").cast("date").alias("last_date"), F.count("*").alias("n")).drop("_w")
