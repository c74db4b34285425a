"""Recurrence labels and topics of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.operators.topics import topic_scores


def label_recurrence(sessions: DataFrame, min_members: int = 100, min_episodes: int = 2, min_episode_members: int = 2, keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """`sessions` with n_member_cluster, n_episode_cluster, n_member_episode and label_berulang.

    1 where the cluster has at least min_members rows and min_episodes episodes and the row's episode at least
    min_episode_members rows. All counts are window aggregates over the sessions' own partitioning.
    """
    cluster = W.partitionBy("window_days", *keys)
    episode = W.partitionBy("window_days", *keys, "temporal_cluster_no")
    rows = sessions.withColumn("n_member_cluster", F.count("*").over(cluster)).withColumn("n_episode_cluster", F.max("temporal_cluster_no").over(cluster).cast("long")).withColumn("n_member_episode", F.count("*").over(episode))
    good = (F.col("n_member_cluster") >= min_members) & (F.col("n_episode_cluster") >= min_episodes) & (F.col("n_member_episode") >= min_episode_members)
    return rows.withColumn("label_berulang", F.coalesce(good.cast("int"), F.lit(0)))


def label_recurrent_clusters(sessions: DataFrame, more_than: int = 1, min_valid: int = 2, keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """`sessions` with n_valid_episodes and label_berulang: an episode is valid with more than `more_than` tickets, and a cluster recurs,
    with all its rows, from `min_valid` valid episodes on."""
    per = sessions.groupBy("window_days", *keys, "temporal_cluster_no").agg(F.count("*").alias("n"))
    valid = per.groupBy("window_days", *keys).agg(F.count_if(F.col("n") > more_than).alias("n_valid_episodes"))
    return sessions.join(valid, ["window_days", *keys]).withColumn("label_berulang", (F.col("n_valid_episodes") >= min_valid).cast("int"))


def label_recap(labels: DataFrame) -> DataFrame:
    """Rows, recurrent rows and their share for each window length."""
    return labels.groupBy("window_days").agg(F.count("*").alias("n_rows"), F.sum("label_berulang").alias("n_recurrent"), F.avg("label_berulang").alias("share_recurrent"))


def select_clusters(labels: DataFrame, recurrent_only: bool = True, top: int = 20) -> DataFrame:
    """The `top` largest clusters (ties: the lesser id), of the recurrent ones only unless told otherwise."""
    per = labels.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.max("label_berulang").alias("is_recurrent"))
    kept = per.where("is_recurrent = 1") if recurrent_only else per
    return kept.orderBy(F.desc("n_members"), "cluster_id").limit(top)


def cluster_topics(tokens: DataFrame, top: int = 10, min_docs: int = 2, bigrams: bool = True) -> DataFrame:
    """(cluster_id, rank, term, score): terms of each cluster by their sum of L2-normalised TF-IDF within the cluster.

    `tokens` is (cluster_id, doc_id, tokens). Document frequencies count within the cluster, idf is ln((1 + n) / (1 + df)) + 1, and
    terms are words and, with `bigrams`, pairs of neighbours. Clusters of fewer than `min_docs` documents have no topic.
    Ties go to the lesser term.
    """
    return top_terms(topic_scores(tokens, top, min_docs, bigrams), top)


def top_terms(scores: DataFrame, top: int) -> DataFrame:
    """(cluster_id, rank, term, score) of the `top` scores of each cluster; rounded scores tie, and ties go to the lesser term."""
    order = W.partitionBy("cluster_id").orderBy(F.round("score", 9).desc(), "term")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster_id", "rank", "term", "score")


def topic_labels(topics: DataFrame, terms: int = 6) -> DataFrame:
    """(cluster_id, label_topic): the first terms of each topic, joined by commas."""
    kept = topics.where(F.col("rank") <= terms).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return kept.select("cluster_id", F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("label_topic"))


def cluster_samples(members: DataFrame, column: str, n: int) -> DataFrame:
    """(cluster_id, samples): the `n` least values of `column` in each cluster, in order. Only n rows of a cluster are gathered."""
    order = W.partitionBy("cluster_id").orderBy(column)
    kept = members.where(F.col(column).isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return kept.groupBy("cluster_id").agg(F.array_sort(F.collect_list(column)).alias("samples"))
