"""Episodes of recurring tickets: sessions, spans, buckets and splits over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.plans.lineage import cut


def _micros(ts: Column | str) -> Column:
    """Microseconds of a time with or without a zone; one without counts as the session's."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def span_floor_days(first: Column, last: Column) -> Column:
    """Whole days between two times, rounded down; 0 where either is null."""
    return F.coalesce(F.floor((_micros(last) - _micros(first)) / 86_400_000_000), F.lit(0)).cast("int")


def span_rounded_days(first: Column, last: Column) -> Column:
    """Days between two times, rounded half to even."""
    return F.bround((_micros(last) - _micros(first)) / 86_400_000_000, 0).cast("int")


def span_date_days(first: Column, last: Column) -> Column:
    """The difference of the calendar dates."""
    return F.datediff(last, first)


def span_fractional_days(first: Column, last: Column) -> Column:
    return (_micros(last) - _micros(first)) / 86_400_000_000


def eligible(span: Column, window_days: Column | int, rule: str = "span_days_strict") -> Column:
    """Whether a cluster of a span may split at all: strict is span - window > 1, gt is span > window, all is any."""
    w = F.lit(window_days) if isinstance(window_days, int) else window_days
    if rule == "span_days_strict":
        return (F.coalesce(span, F.lit(0)) - w) > 1
    if rule == "span_days_gt":
        return F.coalesce(span, F.lit(0)) > w
    if rule == "all":
        return F.lit(True)
    raise ValueError(f"unknown rule {rule!r}")


def eligible_members(members: DataFrame, windows: list[int], rule: str = "span_days_strict", keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Rows with a time, of eligible clusters, once for each window length (column window_days).

    The span comes from a window aggregate over the same partitioning that the sessions need, so no cluster table is joined.
    """
    timed = members.where("ts IS NOT NULL")
    over = W.partitionBy(*keys)
    spanned = timed.withColumn("span_days", span_date_days(F.min("ts").over(over), F.max("ts").over(over)))
    each = spanned.withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in windows])))
    return each.where(eligible(F.col("span_days"), F.col("window_days"), rule))


def sessionize(members: DataFrame, windows: list[int], rule: str = "span_days_strict", keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """`members` with gap_days, temporal_cluster_no and temporal_cluster_id, for each window length.

    A gap in calendar dates of more than window_days starts a new episode; the first row has a null gap and episode 1. Order is time,
    then incident. Rows without a time are left out; rows at one time follow each other by incident.
    """
    rows = eligible_members(members, windows, rule, keys)
    order = W.partitionBy(*keys, "window_days").orderBy("ts", "incident_id")
    rows = rows.withColumn("gap_days", F.datediff("ts", F.lag("ts").over(order)))
    number = (F.sum(F.when(F.col("gap_days") > F.col("window_days"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)) + 1).cast("int")
    return rows.withColumn("temporal_cluster_no", number).withColumn("temporal_cluster_id", F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.col("temporal_cluster_no").cast("string")))


def window_summary(sessions: DataFrame, windows: list[int], keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """One row for each window length: eligible, split and stable clusters with shares, and episodes: total, mean, median.

    A length without eligible clusters gets a row of zeros.
    """
    per = sessions.groupBy("window_days", *keys).agg(F.max("temporal_cluster_no").alias("episodes"))
    n = F.count("*")
    split, stable = F.count_if(F.col("episodes") > 1), F.count_if(F.col("episodes") == 1)
    found = per.groupBy("window_days").agg(n.alias("n_clusters_eligible"), split.alias("n_clusters_split"), stable.alias("n_clusters_stable"), (split / n).alias("prop_split"), (stable / n).alias("prop_stable"), F.sum("episodes").alias("total_episodes"), F.avg("episodes").alias("avg_episode"), F.median("episodes").alias("median_episode"))
    every = sessions.sparkSession.createDataFrame([(w,) for w in windows], "window_days int")
    return every.join(F.broadcast(found), "window_days", "left").fillna(0)


def sessionize_timestamps(members: DataFrame, window_days: int, keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Episodes by exact time: a gap of more than window_days * 24 h splits. Rows without a time are an episode each.

    episode_id is dense over all episodes, in the order of cluster and episode. It is a running sum of episode counts
    over clusters, not a rank over rows, so only one row for each cluster passes the global order.
    """
    gap = F.lit(window_days * 86_400_000_000)
    order = W.partitionBy(*keys).orderBy(F.col("ts").asc_nulls_last(), "incident_id")
    before = F.lag("ts").over(order)
    new = F.col("ts").isNull() | before.isNull() | ((_micros("ts") - _micros(before)) > gap)
    rows = members.withColumn("_new", new.cast("int"))
    rows = rows.withColumn("episode_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")
    counts = cut(rows.groupBy(*keys).agg(F.max("episode_no").alias("_n")))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(offsets, list(keys)).withColumn("episode_id", F.col("_before") + F.col("episode_no") - 1).drop("_before")


def episode_metrics(episodes: DataFrame) -> DataFrame:
    """Clusters, episodes, mean episode size, single-ticket episodes and rows without a time, in one row."""
    per = episodes.groupBy("episode_id").agg(F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("z"))
    return per.agg(F.count("*").alias("n_episodes"), F.avg("n").alias("avg_size"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.coalesce(F.sum("z"), F.lit(0)).alias("n_without_time"))


def day_bucket(ts: Column, width: int) -> tuple[Column, Column]:
    """(start, end) dates of the tumbling bucket of `width` days, counted from 1970-01-01."""
    first = F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(F.unix_date(ts.cast("date")) / width) * width).cast("int"))
    return first, F.date_add(first, width - 1)


def pair_day_differences(pairs: DataFrame) -> DataFrame:
    """Day differences of pairs (ts_a, ts_b): count, median, mean, p90 and percentages within 7, 14 and 30 days."""
    d = F.abs(F.datediff("ts_a", "ts_b"))
    days = pairs.where("ts_a IS NOT NULL AND ts_b IS NOT NULL").select(d.alias("d"))
    within = [(F.avg((F.col("d") <= w).cast("int")) * 100).alias(f"pct_le_{w}") for w in (7, 14, 30)]
    return days.agg(F.count("*").alias("n_pairs"), F.median("d").alias("median_days"), F.avg("d").alias("mean_days"), F.expr("percentile(d, 0.9)").alias("p90_days"), *within)


def later_of_pairs(pairs: DataFrame, days: int) -> DataFrame:
    """The distinct later incidents of pairs (a, ts_a, b, ts_b) at most `days` apart; the greater id at equal times."""
    near = pairs.where(F.abs(F.datediff("ts_a", "ts_b")) <= days)
    later = F.when((F.col("ts_a") > F.col("ts_b")) | ((F.col("ts_a") == F.col("ts_b")) & (F.col("a") > F.col("b"))), F.col("a")).otherwise(F.col("b"))
    return near.select(later.alias("incident_id")).distinct()


def calendar_features(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """`rows` with dow (Monday 0), month, hour, day and has_time."""
    t = F.col(ts)
    return rows.withColumns({"dow": F.weekday(t), "month": F.month(t), "hour": F.hour(t), "day": F.dayofmonth(t), "has_time": t.isNotNull().cast("int")})


def cutoff_split(rows: DataFrame, cutoff: str, ts: Column) -> DataFrame:
    """`rows` with split_name: test from the cutoff on, train before it and where there is no time."""
    return rows.withColumn("split_name", F.when(ts >= F.lit(cutoff).cast("timestamp"), "test").otherwise("train"))


def ratio_split(rows: DataFrame, test_share: float, order: list[str]) -> DataFrame:
    """`rows` with split_name: the first floor((1 - share) * n) rows in order are train, at least 1 and at most n - 1.

    The boundary is found by an ordered limit over the key columns alone.
    """
    n = rows.count()
    k = max(1, min(n - 1, int((1 - test_share) * n))) if n > 1 else n
    if n == 0:
        return rows.withColumn("split_name", F.lit(None).cast("string"))
    edge = rows.select(*order).orderBy(*[F.col(c).asc_nulls_last() for c in order]).offset(k - 1).limit(1)
    bound = edge.select(F.struct(*order).alias("_edge"))
    return rows.crossJoin(F.broadcast(bound)).withColumn("split_name", F.when(F.struct(*order) <= F.col("_edge"), "train").otherwise("test")).drop("_edge")
