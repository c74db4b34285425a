"""Queries: episodes, splits, recurrence labels and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprise.catalog.registry import ACTIVITY, TEXTS, TICKETS, activity, load, query, texts, tickets
from reprise.operators import labeling as L
from reprise.operators import temporal as T

WINDOWS = [30, 180, 365]


def _sessions(spark, sf, windows=WINDOWS, rule="span_days_strict"):
    return T.sessionize(tickets(spark, sf), windows, rule)


def _sql(windows=WINDOWS, rule="coalesce(span, 0) - w > 1", more="", tail="SELECT * FROM e") -> str:
    return f"""
WITH {TICKETS},
s AS (SELECT *, date_diff('day', CAST(min(ts) OVER (PARTITION BY cluster_id) AS DATE), CAST(max(ts) OVER (PARTITION BY cluster_id) AS DATE)) AS span FROM t WHERE ts IS NOT NULL),
m AS (SELECT s.*, w FROM s, unnest({windows}) AS u(w) WHERE {rule}),
g AS (SELECT *, date_diff('day', CAST(lag(ts) OVER o AS DATE), CAST(ts AS DATE)) AS gap FROM m WINDOW o AS (PARTITION BY cluster_id, w ORDER BY ts, incident_id)),
e AS (SELECT *, 1 + sum(CASE WHEN gap > w THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id, w ORDER BY ts, incident_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
{more}
{tail}
"""


_OUT = ["window_days", "cluster_id", "incident_id", "gap_days", "temporal_cluster_no", "temporal_cluster_id"]
_OUT_SQL = "SELECT w AS window_days, cluster_id, incident_id, gap AS gap_days, CAST(no AS INTEGER) AS temporal_cluster_no, cluster_id || '-' || no AS temporal_cluster_id FROM e"


@query("TMP-01", _sql([180], tail=_OUT_SQL))
def sessions(spark, sf):
    return _sessions(spark, sf, [180]).select(_OUT)


_SUMMARY = """, p AS (SELECT w, cluster_id, max(no) AS k FROM e GROUP BY ALL)"""
_SUMMARY_SQL = "SELECT u.w AS window_days, coalesce(count(cluster_id), 0) AS n_clusters_eligible, count(*) FILTER (k > 1) AS n_clusters_split, count(*) FILTER (k = 1) AS n_clusters_stable, coalesce(round(count(*) FILTER (k > 1) / nullif(count(cluster_id), 0), 9), 0.0) AS prop_split, coalesce(round(count(*) FILTER (k = 1) / nullif(count(cluster_id), 0), 9), 0.0) AS prop_stable, CAST(coalesce(sum(k), 0) AS BIGINT) AS total_episodes, coalesce(round(avg(k), 9), 0.0) AS avg_episode, coalesce(median(k), 0.0) AS median_episode FROM (SELECT unnest({w}) AS w) u LEFT JOIN p ON p.w = u.w GROUP BY u.w"


def _summary(spark, sf, windows, rule):
    s = T.window_summary(_sessions(spark, sf, windows, rule), windows)
    return s.withColumns({c: F.round(c, 9) for c in ("prop_split", "prop_stable", "avg_episode")})


@query("TMP-02", _sql([365, 5000], more=_SUMMARY, tail=_SUMMARY_SQL.format(w=[365, 5000])))
def summary(spark, sf):
    return _summary(spark, sf, [365, 5000], "span_days_strict")


@query("TMP-03", _sql([7, 14, 30], "span > w", _SUMMARY, _SUMMARY_SQL.format(w=[7, 14, 30])))
def many_windows(spark, sf):
    return _summary(spark, sf, [7, 14, 30], "span_days_gt")


@query("FLT-08", _sql([365], "true", ", p AS (SELECT DISTINCT cluster_id, coalesce(span, 0) - w > 1 AS strict, coalesce(span, 0) > w AS gt, true AS anyone FROM m)", "SELECT count(*) FILTER (strict) AS n_strict, count(*) FILTER (gt) AS n_gt, count(*) AS n_all FROM p"))
def eligibility(spark, sf):
    per = tickets(spark, sf).where("ts IS NOT NULL").groupBy("cluster_id").agg(T.span_date_days(F.min("ts"), F.max("ts")).alias("span"))
    return per.agg(F.count_if(T.eligible(F.col("span"), 365)).alias("n_strict"), F.count_if(T.eligible(F.col("span"), 365, "span_days_gt")).alias("n_gt"), F.count_if(T.eligible(F.col("span"), 365, "all")).alias("n_all"))


@query("TMP-04", f"WITH {ACTIVITY} SELECT cluster_id, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS span_date, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS INTEGER) AS span_floor, CAST(round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000, 0) AS INTEGER) AS span_rounded, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000, 6) AS span_fractional FROM a GROUP BY cluster_id")
def spans(spark, sf):
    a, b = F.min("ts"), F.max("ts")
    return activity(spark, sf).groupBy("cluster_id").agg(T.span_date_days(a, b).alias("span_date"), T.span_floor_days(a, b).alias("span_floor"), T.span_rounded_days(a, b).alias("span_rounded"), F.round(T.span_fractional_days(a, b), 6).alias("span_fractional"))


_TS = f"""WITH {ACTIVITY},
g AS (SELECT *, CASE WHEN ts IS NULL OR lag(ts) OVER o IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER o) > 86400000000 THEN 1 ELSE 0 END AS n FROM a WINDOW o AS (PARTITION BY cluster_id ORDER BY ts NULLS LAST, incident_id)),
e AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id ORDER BY ts NULLS LAST, incident_id ROWS UNBOUNDED PRECEDING) AS no FROM g),
d AS (SELECT *, dense_rank() OVER (ORDER BY cluster_id, no) - 1 AS episode_id FROM e)
"""


@query("TMP-05", _TS + "SELECT cluster_id, incident_id, CAST(no AS INTEGER) AS episode_no, episode_id FROM d")
def timestamp_episodes(spark, sf):
    return T.sessionize_timestamps(activity(spark, sf), 1).select("cluster_id", "incident_id", "episode_no", "episode_id")


@query("TMP-06", _TS + ", p AS (SELECT episode_id, count(*) AS n, count(*) FILTER (ts IS NULL) AS z FROM d GROUP BY 1) SELECT count(*) AS n_episodes, round(avg(n), 9) AS avg_size, count(*) FILTER (n = 1) AS n_singletons, CAST(sum(z) AS BIGINT) AS n_without_time FROM p")
def timestamp_metrics(spark, sf):
    return T.episode_metrics(T.sessionize_timestamps(activity(spark, sf), 1)).withColumn("avg_size", F.round("avg_size", 9))


@query("TMP-07", f"WITH {TICKETS}, b AS (SELECT CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 30.0) * 30 AS INTEGER) AS k FROM t) SELECT DATE '1970-01-01' + k AS bucket_start, DATE '1970-01-01' + k + 29 AS bucket_end, count(*) AS n FROM b GROUP BY k")
def tumbling(spark, sf):
    start, end = T.day_bucket(F.col("ts"), 30)
    return tickets(spark, sf).groupBy(start.alias("bucket_start"), end.alias("bucket_end")).agg(F.count("*").alias("n"))


_PAIRS = f"WITH {TICKETS}, p AS (SELECT a.incident_id AS a, a.ts AS ts_a, b.incident_id AS b, b.ts AS ts_b FROM t a JOIN t b ON a.cluster_id = b.cluster_id AND a.modul = b.modul AND a.incident_id < b.incident_id)"


def _pairs(spark, sf):
    t = tickets(spark, sf)
    left, right = [t.select("cluster_id", "modul", F.col("incident_id").alias(k), F.col("ts").alias(f"ts_{k}")) for k in "ab"]
    return left.join(right, ["cluster_id", "modul"]).where("a < b")


@query("TMP-08", _PAIRS + ", d AS (SELECT abs(date_diff('day', CAST(ts_a AS DATE), CAST(ts_b AS DATE))) AS d FROM p) SELECT count(*) AS n_pairs, median(d) AS median_days, round(avg(d), 6) AS mean_days, round(quantile_cont(d, 0.9), 6) AS p90_days, round(100.0 * avg(CASE WHEN d <= 7 THEN 1 ELSE 0 END), 6) AS pct_le_7, round(100.0 * avg(CASE WHEN d <= 14 THEN 1 ELSE 0 END), 6) AS pct_le_14, round(100.0 * avg(CASE WHEN d <= 30 THEN 1 ELSE 0 END), 6) AS pct_le_30 FROM d")
def pair_days(spark, sf):
    d = T.pair_day_differences(_pairs(spark, sf))
    return d.withColumns({c: F.round(c, 6) for c in ("mean_days", "p90_days", "pct_le_7", "pct_le_14", "pct_le_30")})


@query("TMP-09", _PAIRS + " SELECT DISTINCT CASE WHEN ts_a > ts_b OR (ts_a = ts_b AND a > b) THEN a ELSE b END AS incident_id FROM p WHERE abs(date_diff('day', CAST(ts_a AS DATE), CAST(ts_b AS DATE))) <= 30")
def later(spark, sf):
    return T.later_of_pairs(_pairs(spark, sf), 30)


@query("TMP-10", f"WITH {ACTIVITY} SELECT incident_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, CAST(day(ts) AS INTEGER) AS day, CASE WHEN ts IS NULL THEN 0 ELSE 1 END AS has_time FROM a")
def calendar(spark, sf):
    return T.calendar_features(activity(spark, sf)).select("incident_id", "dow", "month", "hour", "day", "has_time")


@query("TMP-11", f"WITH {TICKETS} SELECT CASE WHEN ts >= TIMESTAMP '2000-01-01' THEN 'test' ELSE 'train' END AS split_name, count(*) AS n FROM t GROUP BY 1")
def cutoff(spark, sf):
    return T.cutoff_split(tickets(spark, sf), "2000-01-01", F.col("ts")).groupBy("split_name").agg(F.count("*").alias("n"))


@query("TMP-12", f"WITH {TICKETS}, r AS (SELECT incident_id, row_number() OVER (ORDER BY ts, incident_id) AS r, count(*) OVER () AS n FROM t) SELECT incident_id, CASE WHEN r <= greatest(1, least(n - 1, CAST(floor(0.8 * n) AS BIGINT))) THEN 'train' ELSE 'test' END AS split_name FROM r")
def ratio(spark, sf):
    return T.ratio_split(tickets(spark, sf), 0.2, ["ts", "incident_id"]).select("incident_id", "split_name")


_LABEL = """, c AS (SELECT *, count(*) OVER (PARTITION BY w, cluster_id) AS nm, max(no) OVER (PARTITION BY w, cluster_id) AS ne, count(*) OVER (PARTITION BY w, cluster_id, no) AS nk FROM e),
l AS (SELECT *, CASE WHEN nm >= 5 AND ne >= 2 AND nk >= 2 THEN 1 ELSE 0 END AS y FROM c)"""


def _labels(spark, sf, windows=(180,)):
    return L.label_recurrence(_sessions(spark, sf, list(windows)), min_members=5)


@query("LBL-01", _sql([180], more=_LABEL, tail="SELECT w AS window_days, cluster_id, incident_id, CAST(no AS INTEGER) AS temporal_cluster_no, nm AS n_member_cluster, CAST(ne AS BIGINT) AS n_episode_cluster, nk AS n_member_episode, y AS label_berulang FROM l"))
def rule_labels(spark, sf):
    return _labels(spark, sf).select("window_days", "cluster_id", "incident_id", "temporal_cluster_no", "n_member_cluster", "n_episode_cluster", "n_member_episode", "label_berulang")


@query("LBL-02", _sql([180], "coalesce(span, 0) - w > 1", _LABEL, "SELECT incident_id, y AS label_berulang FROM l").replace("WHERE ts IS NOT NULL", "WHERE ts IS NOT NULL AND cluster_id % 10 <> 0"))
def semantic_labels(spark, sf):
    """Every tenth cluster stands for noise: it is left out of the counts and of the rows."""
    rows = tickets(spark, sf).where("cluster_id % 10 <> 0")
    return L.label_recurrence(T.sessionize(rows, [180]), min_members=5).select("incident_id", "label_berulang")


@query("LBL-03", _sql(WINDOWS, more=_LABEL, tail="SELECT w AS window_days, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_recurrent, round(avg(y), 9) AS share_recurrent FROM l GROUP BY w"))
def recap(spark, sf):
    return L.label_recap(_labels(spark, sf, WINDOWS)).withColumn("share_recurrent", F.round("share_recurrent", 9))


_VALID = ", k AS (SELECT w, cluster_id, no, count(*) AS n FROM e GROUP BY ALL), v AS (SELECT w, cluster_id, count(*) FILTER (n > 1) AS nv FROM k GROUP BY ALL)"


@query("LBL-04", _sql([180], more=_VALID, tail="SELECT cluster_id, incident_id, nv AS n_valid_episodes, CASE WHEN nv >= 2 THEN 1 ELSE 0 END AS label_berulang FROM e JOIN v USING (w, cluster_id)"))
def utility_labels(spark, sf):
    return L.label_recurrent_clusters(_sessions(spark, sf, [180])).select("cluster_id", "incident_id", "n_valid_episodes", "label_berulang")


@query("LBL-07", _sql([180], more=_LABEL, tail="SELECT cluster_id, count(*) AS n_members, max(y) AS is_recurrent FROM l GROUP BY 1 HAVING max(y) = 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def chosen_clusters(spark, sf):
    return L.select_clusters(_labels(spark, sf))


@query("LBL-08", f"WITH {TICKETS}, r AS (SELECT cluster_id, incident_id, row_number() OVER (PARTITION BY cluster_id ORDER BY incident_id) AS r FROM t) SELECT cluster_id, string_agg(incident_id, ',' ORDER BY incident_id) AS samples FROM r WHERE r <= 10 GROUP BY 1")
def samples(spark, sf):
    return L.cluster_samples(tickets(spark, sf), "incident_id", 10).select("cluster_id", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


#: Words of ASCII letters of documents, by source as cluster; the same in both dialects.
_WORDS = f"""WITH {TEXTS}, w AS (SELECT modul AS cluster_id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws FROM x),
u AS (SELECT cluster_id, doc_id, unnest(ws) AS term FROM w UNION ALL SELECT cluster_id, doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) > 1),
f AS (SELECT cluster_id, doc_id, term, count(*) AS tf FROM u GROUP BY ALL),
df AS (SELECT cluster_id, term, count(*) AS df FROM f GROUP BY ALL),
n AS (SELECT cluster_id, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT f.*, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM f JOIN df USING (cluster_id, term) JOIN n USING (cluster_id) WHERE n >= 2),
q AS (SELECT cluster_id, doc_id, sqrt(sum(w * w)) AS q FROM v GROUP BY ALL),
s AS (SELECT cluster_id, term, sum(w / q) AS score FROM v JOIN q USING (cluster_id, doc_id) GROUP BY ALL),
r AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, term) AS rank, term, score FROM s)
"""


def _tokens(spark, sf):
    return texts(spark, sf).select(F.col("modul").alias("cluster_id"), "doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), 0).alias("tokens"))


@query("LBL-05", _WORDS + "SELECT cluster_id, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM r WHERE rank <= 10")
def topics(spark, sf):
    return L.cluster_topics(_tokens(spark, sf)).withColumn("score", F.round("score", 6))


@query("LBL-06", _WORDS + "SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS label_topic FROM r WHERE rank <= 6 GROUP BY 1")
def labels_of_topics(spark, sf):
    return L.topic_labels(L.cluster_topics(_tokens(spark, sf)))


@query("LBL-13", _sql([180], more=_LABEL + ", k AS (SELECT cluster_id, max(y) AS is_recurrent, count(*) AS n_members FROM l GROUP BY 1)", tail="SELECT k.cluster_id, n_members, is_recurrent, c_mktsegment AS label_topic FROM k JOIN customer ON c_custkey = k.cluster_id"))
def topic_view(spark, sf):
    """Customer segments stand for the topics that are joined to the clusters."""
    per = _labels(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.max("label_berulang").alias("is_recurrent"))
    topics = load(spark, sf, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_mktsegment").alias("label_topic"))
    return per.join(topics, "cluster_id")
