"""Queries: data quality and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprise.catalog.episodes import _LABEL, _labels, _sessions, _sql
from reprise.catalog.registry import ACTIVITY, TEXTS, TICKETS, activity, load, query, texts, tickets
from reprise.operators import quality as Q
from reprise.operators import stats as S
from reprise.operators import temporal as T


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- data quality ------------------------------------------------------------------------------------------------
_COLS = ["doc_id", "text", "site", "modul"]


@query("DQ-01", f"WITH {TEXTS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS n_empty, round_even(count(*) FILTER ({c} IS NULL) * 100 / count(*), 2) AS pct_null, round_even(count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') * 100 / count(*), 2) AS pct_empty FROM x" for c in _COLS))
def missing(spark, sf):
    return Q.missing_profile(texts(spark, sf))


@query("DQ-02", f"WITH {TEXTS}, d AS (SELECT DISTINCT text, doc_id FROM x WHERE text IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY text) AS n FROM d) SELECT md5(text) AS text_md5, max(n) AS n, string_agg(doc_id, ',' ORDER BY doc_id) FILTER (r <= 5) AS examples FROM r WHERE n > 1 GROUP BY text")
def duplicates(spark, sf):
    d = Q.repeated_texts(texts(spark, sf), "doc_id", "text")
    return d.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "n", F.array_join(F.transform("examples", lambda v: v.cast("string")), ",").alias("examples"))


_MARK = f"""WITH {TEXTS},
n AS (SELECT *, text IS NULL OR trim(text) = '' OR site IS NULL OR modul IS NULL AS missing FROM x),
c AS (SELECT *, row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) > 1 AS copy FROM n WHERE NOT missing),
l AS (SELECT *, count(*) FILTER (NOT copy) OVER (PARTITION BY modul) AS left_over FROM c),
m AS (SELECT doc_id, modul, site, CASE WHEN copy THEN 'duplicate' WHEN left_over < 48 THEN 'low_module' ELSE 'kept' END AS reason FROM l UNION ALL SELECT doc_id, modul, site, 'null' FROM n WHERE missing)
"""


def _marked(spark, sf):
    return Q.mark_eligibility(texts(spark, sf), ["text", "site", "modul"], "text", "modul", ["doc_id"], 48)


for _id, _what in (("DQ-03", "reason <> 'null'"), ("DQ-04", "reason NOT IN ('null', 'duplicate')"), ("DQ-05", "reason = 'kept'")):
    query(_id, _MARK + f"SELECT doc_id FROM m WHERE {_what}")(lambda spark, sf, w=_what: _marked(spark, sf).where(w).select("doc_id"))


@query("DQ-06", _MARK + "SELECT reason, count(*) AS n FROM m GROUP BY 1")
def reasons(spark, sf):
    return _marked(spark, sf).groupBy("reason").agg(F.count("*").alias("n"))


@query("DQ-07", _MARK + "SELECT modul, count(*) AS before, count(*) FILTER (reason = 'kept') AS after, round_even(count(*) FILTER (reason = 'kept') * 100 / count(*), 2) AS coverage_pct, CASE WHEN count(*) FILTER (reason = 'kept') > 0 THEN 'Layak' ELSE 'Tidak Layak' END AS status FROM m GROUP BY 1")
def coverage(spark, sf):
    return Q.module_coverage(_marked(spark, sf), "modul")


@query("DQ-08", rf"WITH {TEXTS}, y AS (SELECT doc_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS t FROM x) SELECT doc_id, t IS NULL OR length(t) < 5 OR len(regexp_split_to_array(t, '\s+')) < 2 OR t IN ('tes', 'test', 'test1', 'test 1', 'cek', 'coba', 'uji', 'ujicoba', 'uji coba', 'abc', 'xx', 'ok', '....', '...', '..', '--', '---', '??', '?') OR regexp_matches(t, '^[-\.\?]{{2,}}$') OR regexp_matches(t, '^[a-z]{{1,4}}$') OR regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '(asd|qwe|zxc){{2,}}') AS meaningless FROM y")
def meaningless(spark, sf):
    return texts(spark, sf).select("doc_id", Q.is_meaningless(F.col("text")).alias("meaningless"))


@query("DQ-09", rf"WITH {TEXTS}, w AS (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda v: v <> '')) AS n FROM x) SELECT count(*) FILTER (n <= 500) AS n_kept, round(quantile_cont(n, 0.95), 6) AS p95_words FROM w")
def word_limits(spark, sf):
    every = Q.word_limit(texts(spark, sf), "text", 1 << 30)
    return every.agg(F.count_if(F.col("n_words") <= 500).alias("n_kept"), F.round(F.percentile("n_words", F.lit(0.95)), 6).alias("p95_words"))


@query("DQ-10", f"WITH {TEXTS} SELECT count(*) AS total, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank_text, count(*) FILTER (site IS NULL OR trim(site) = '') AS blank_site, count(*) FILTER (modul IS NULL OR trim(modul) = '') AS blank_modul FROM x")
def kpis(spark, sf):
    blank = lambda c: F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(f"blank_{c}")
    return texts(spark, sf).agg(F.count("*").alias("total"), blank("text"), blank("site"), blank("modul"))


@query("DQ-11", "SELECT round(100.0 * avg(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END), 6) AS pct_toxic, round(100.0 * avg(CASE WHEN quality IS NULL THEN 1 ELSE 0 END), 6) AS pct_quality FROM documents LEFT JOIN labels USING (doc_id)")
def null_shares(spark, sf):
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    return rows.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 6).alias(f"pct_{c}") for c in ("toxic", "quality")])


# ---- aggregates --------------------------------------------------------------------------------------------------
@query("AGG-01", f"WITH {TICKETS}, c AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS m, count(*) AS n FROM t WHERE price > 480000 GROUP BY 1), s AS (SELECT CAST(unnest(generate_series((SELECT min(m) FROM c)::TIMESTAMP, (SELECT max(m) FROM c)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS m) SELECT s.m AS month, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.m = s.m")
def months(spark, sf):
    return S.monthly_trend(tickets(spark, sf).where("price > 480000"))


@query("AGG-02", f"WITH {TEXTS} SELECT trim(modul) AS value, count(*) AS n FROM x WHERE trim(modul) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def tops(spark, sf):
    return S.top_values(texts(spark, sf), "modul", 10)


_WC = rf"w AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z_]+')) AS INTEGER) AS wc FROM x)"


def _wc(spark, sf):
    return texts(spark, sf).select("doc_id", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9A-Za-z_]+"), 0)).alias("wc"))


@query("AGG-03", f"WITH {TEXTS}, {_WC} SELECT min(wc) AS min_words, max(wc) AS max_words, round(avg(wc), 6) AS mean_words FROM w")
def word_stats(spark, sf):
    return _wc(spark, sf).agg(F.min("wc").alias("min_words"), F.max("wc").alias("max_words"), F.round(F.avg("wc"), 6).alias("mean_words"))


@query("AGG-04", f"WITH {TEXTS}, {_WC}, e AS (SELECT CAST(min(wc) AS DOUBLE) AS a, (CAST(max(wc) AS DOUBLE) - min(wc)) / 12 AS d FROM w), k AS (SELECT greatest(1, least(12, CAST(ceil((wc - a) / d) AS INTEGER))) AS bin, count(*) AS n FROM w, e GROUP BY 1) SELECT CAST(u.bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 13)) AS bin) u LEFT JOIN k USING (bin)")
def word_bins(spark, sf):
    return S.equal_width_bins(_wc(spark, sf), "wc", 12)


@query("AGG-05", f"WITH {TEXTS}, u AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS value FROM x) SELECT value, count(*) AS n FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def top_words(spark, sf):
    words = texts(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return S.top_values(words, "word", 40)


@query("AGG-06", f"WITH {TEXTS} SELECT coalesce(modul, 'UNKNOWN') AS modul, coalesce(site, 'UNKNOWN') AS sub_modul, count(*) AS n FROM x GROUP BY ALL")
def treemap(spark, sf):
    return texts(spark, sf).groupBy(F.coalesce("modul", F.lit("UNKNOWN")).alias("modul"), F.coalesce("site", F.lit("UNKNOWN")).alias("sub_modul")).agg(F.count("*").alias("n"))


@query("AGG-07", f"WITH {TICKETS} SELECT cluster_id, count(*) AS cluster_size, strftime(min(ts), '%Y-%m-%d') AS min_time, strftime(max(ts), '%Y-%m-%d') AS max_time, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS INTEGER) AS span_days FROM t GROUP BY 1")
def clusters(spark, sf):
    c = S.cluster_summary(tickets(spark, sf), ["cluster_id"], T.span_floor_days(F.col("min_time"), F.col("max_time")))
    return c.withColumns({k: F.date_format(k, "yyyy-MM-dd") for k in ("min_time", "max_time")})


_SIZES = f"WITH {TEXTS}, s AS (SELECT md5(coalesce(text, '')) AS k, count(*) AS n FROM x GROUP BY 1)"


def _sizes(spark, sf):
    return texts(spark, sf).groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("k")).agg(F.count("*").alias("n"))


@query("AGG-08", _SIZES + " SELECT count(*) AS n_clusters, count(*) FILTER (n = 1) AS n_singletons FROM s")
def singletons(spark, sf):
    return _sizes(spark, sf).agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_singletons"))


@query("AGG-09", _SIZES + " SELECT count(*) AS n_clusters, count(*) FILTER (n = 1) AS n_singletons, round(count(*) FILTER (n = 1) / count(*), 9) AS singleton_share, max(n) AS max_size, median(n) AS median_size, round(quantile_cont(n, 0.95), 6) AS p95_size, round((SELECT sum(n) FROM (SELECT n FROM s ORDER BY n DESC LIMIT 10)) / sum(n), 9) AS top10_share FROM s")
def size_spread(spark, sf):
    return _rounded(_rounded(S.size_distribution(_sizes(spark, sf)), "singleton_share", "top10_share", places=9), "p95_size")


_PERMOD = f"WITH {TICKETS}, c AS (SELECT modul, cluster_id, count(*) AS n FROM t GROUP BY ALL)"


def _permod(spark, sf):
    return tickets(spark, sf).groupBy("modul", "cluster_id").agg(F.count("*").alias("n"))


@query("AGG-10", _PERMOD + " SELECT modul, count(*) AS n_clusters, max(n) AS max_size, round(quantile_cont(n, 0.9), 6) AS p90_size, count(*) FILTER (n >= 3) AS n_ge_3, count(*) FILTER (n >= 5) AS n_ge_5 FROM c GROUP BY 1")
def module_clusters(spark, sf):
    return _permod(spark, sf).groupBy("modul").agg(F.count("*").alias("n_clusters"), F.max("n").alias("max_size"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("p90_size"), F.count_if(F.col("n") >= 3).alias("n_ge_3"), F.count_if(F.col("n") >= 5).alias("n_ge_5"))


@query("AGG-11", _PERMOD + ", p AS (SELECT modul, round(avg(n), 6) AS avg_size, quantile_cont(n, 0.5) AS median_size, round(100.0 * count(*) FILTER (n = 1) / count(*), 6) AS pct_singleton FROM c GROUP BY 1), q AS (SELECT modul, count(*) AS n_open FROM t WHERE site = 'O' GROUP BY 1) SELECT coalesce(p.modul, q.modul) AS modul, avg_size, median_size, pct_singleton, n_open FROM p FULL OUTER JOIN q ON p.modul = q.modul")
def run_aggregates(spark, sf):
    p = _permod(spark, sf).groupBy("modul").agg(F.round(F.avg("n"), 6).alias("avg_size"), F.median("n").alias("median_size"), F.round(F.count_if(F.col("n") == 1) * 100 / F.count("*"), 6).alias("pct_singleton"))
    q = tickets(spark, sf).where("site = 'O'").groupBy("modul").agg(F.count("*").alias("n_open"))
    return p.join(q, "modul", "full")


@query("AGG-12", _PERMOD + " SELECT modul, cluster_id, n FROM c WHERE n >= 5")
def having(spark, sf):
    return _permod(spark, sf).where("n >= 5")


@query("AGG-13", f"WITH {TICKETS} SELECT modul, count(*) FILTER (site = 'F') AS n_f, round(100.0 * count(*) FILTER (site = 'F') / nullif(count(*) FILTER (site <> 'P'), 0), 6) AS pct_f FROM t GROUP BY 1")
def filtered_counts(spark, sf):
    n = F.count_if(F.col("site") == "F")
    return tickets(spark, sf).groupBy("modul").agg(n.alias("n_f"), F.round(F.try_divide(n * 100.0, F.count_if(F.col("site") != "P")), 6).alias("pct_f"))


@query("AGG-14", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def crosstab(spark, sf):
    return load(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("AGG-15", f"WITH {TICKETS} SELECT site, CAST(round(avg(price), 2) AS DOUBLE) AS avg_price, CAST(round(median(price), 2) AS DOUBLE) AS median_price FROM t GROUP BY 1")
def averages(spark, sf):
    return tickets(spark, sf).groupBy("site").agg(F.round(F.avg("price"), 2).alias("avg_price"), F.round(F.median("price"), 2).alias("median_price"))


@query("AGG-16", "WITH d AS (SELECT source, toxic FROM documents JOIN labels USING (doc_id)) SELECT source, count(*) AS n, round(100.0 * avg(toxic), 6) AS pct FROM d GROUP BY 1 HAVING count(*) >= 10 ORDER BY pct DESC, source LIMIT 10")
def category_shares(spark, sf):
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("toxic") * 100, 6).alias("pct")).where("n >= 10").orderBy(F.desc("pct"), "source").limit(10)


@query("AGG-17", f"WITH {TICKETS} SELECT count(*) AS n_rows, count(*) FILTER (ts IS NULL) AS null_ts, count(DISTINCT incident_id) AS n_tickets, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT CASE WHEN cluster_id % 10 = 0 THEN incident_id END) AS noise_tickets FROM t")
def diagnostics(spark, sf):
    return tickets(spark, sf).agg(F.count("*").alias("n_rows"), F.count_if(F.col("ts").isNull()).alias("null_ts"), F.countDistinct("incident_id").alias("n_tickets"), F.countDistinct("cluster_id").alias("n_clusters"), F.countDistinct(F.when(F.col("cluster_id") % 10 == 0, F.col("incident_id"))).alias("noise_tickets"))


@query("AGG-18", _sql([180], more=", k AS (SELECT cluster_id, no, count(*) AS n FROM e GROUP BY ALL)", tail="SELECT cluster_id, count(*) AS n_episodes, count(*) FILTER (n >= 2) AS n_repeat, CAST(sum(n) AS BIGINT) AS n_tickets FROM k GROUP BY 1 HAVING count(*) FILTER (n >= 2) >= 2 ORDER BY n_repeat DESC, cluster_id LIMIT 20"))
def repeat_summary(spark, sf):
    k = _sessions(spark, sf, [180]).groupBy("cluster_id", "temporal_cluster_no").agg(F.count("*").alias("n"))
    per = k.groupBy("cluster_id").agg(F.count("*").alias("n_episodes"), F.count_if(F.col("n") >= 2).alias("n_repeat"), F.sum("n").alias("n_tickets"))
    return per.where("n_repeat >= 2").orderBy(F.desc("n_repeat"), "cluster_id").limit(20)


@query("AGG-19", f"WITH {ACTIVITY} SELECT CAST(date_trunc('week', ts) AS DATE) AS bucket, modul, count(*) AS n FROM a GROUP BY ALL")
def trend(spark, sf):
    return S.bucket_trend(activity(spark, sf), "week", ["modul"])


@query("AGG-20", f"WITH {ACTIVITY} SELECT cluster_id, count(*) AS n, count(DISTINCT date_trunc('day', ts)) AS active_buckets, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000, 6) AS span_days, CASE WHEN count(DISTINCT date_trunc('day', ts)) >= 25 THEN 1 ELSE 0 END AS is_recurring FROM a GROUP BY 1")
def bucket_recurrence(spark, sf):
    return S.recurrence_by_buckets(activity(spark, sf), "day", ["cluster_id"], 25).select("cluster_id", "n", "active_buckets", F.round("span_days", 6).alias("span_days"), "is_recurring")


@query("AGG-21", f"WITH {ACTIVITY}, k AS (SELECT cluster_id FROM a GROUP BY 1 ORDER BY count(*) DESC, cluster_id LIMIT 15) SELECT cluster_id, CAST(date_trunc('week', ts) AS DATE) AS bucket, count(*) AS n FROM a JOIN k USING (cluster_id) GROUP BY ALL")
def heatmap(spark, sf):
    a = activity(spark, sf)
    top = a.groupBy("cluster_id").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "cluster_id").limit(15).select("cluster_id")
    return S.bucket_trend(a.join(F.broadcast(top), "cluster_id"), "week", ["cluster_id"])


@query("AGG-22", f"WITH {TICKETS} SELECT cluster_id, CAST(date_trunc('month', ts) AS DATE) AS bucket, count(*) AS n FROM t GROUP BY ALL")
def monthly_points(spark, sf):
    return S.bucket_trend(tickets(spark, sf), "month", ["cluster_id"])


@query("AGG-23", f"WITH {ACTIVITY} SELECT strftime(ts, '%Y-%m') AS period, 'C' || lpad(CAST(cluster_id AS VARCHAR), 3, '0') AS label, count(*) AS n FROM a GROUP BY ALL")
def period_labels(spark, sf):
    return activity(spark, sf).groupBy(F.date_format("ts", "yyyy-MM").alias("period"), F.concat(F.lit("C"), F.lpad(F.col("cluster_id").cast("string"), 3, "0")).alias("label")).agg(F.count("*").alias("n"))


@query("AGG-24", f"WITH {ACTIVITY} SELECT cluster_id, CAST(ts AS DATE) AS day, count(*) AS n, max(CASE WHEN modul = 'purchase' THEN 1 ELSE 0 END) AS any_flag FROM a GROUP BY ALL")
def daily_flags(spark, sf):
    return activity(spark, sf).groupBy("cluster_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.max((F.col("modul") == "purchase").cast("int")).alias("any_flag"))


@query("AGG-25", _sql([180], more=", k AS (SELECT cluster_id FROM e GROUP BY 1 ORDER BY count(*) DESC, cluster_id LIMIT 30)", tail="SELECT cluster_id, CAST(no AS INTEGER) AS temporal_cluster_no, strftime(min(ts), '%Y-%m-%d') AS start_day, strftime(max(ts), '%Y-%m-%d') AS end_day, strftime(make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2), '%Y-%m-%d %H') AS mid_hour, count(*) AS size, round(sqrt(count(*)), 6) AS size_scaled FROM e JOIN k USING (cluster_id) GROUP BY cluster_id, no"))
def intervals(spark, sf):
    e = S.episode_intervals(_sessions(spark, sf, [180]), ["cluster_id"])
    return e.select("cluster_id", "temporal_cluster_no", F.date_format("start_ts", "yyyy-MM-dd").alias("start_day"), F.date_format("end_ts", "yyyy-MM-dd").alias("end_day"), F.date_format("mid_ts", "yyyy-MM-dd HH").alias("mid_hour"), "size", F.round("size_scaled", 6).alias("size_scaled"))


@query("AGG-26", _sql([180], more=", k AS (SELECT cluster_id, no, count(*) AS size FROM e GROUP BY ALL)", tail="SELECT size, count(*) AS n FROM k GROUP BY 1"))
def episode_sizes(spark, sf):
    return _sessions(spark, sf, [180]).groupBy("cluster_id", "temporal_cluster_no").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("AGG-27", f"WITH {TICKETS} SELECT cluster_id, count(*) AS n, count(DISTINCT site) AS n_site, count(DISTINCT modul) AS n_modul FROM t GROUP BY 1")
def distinct_sites(spark, sf):
    return tickets(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n"), F.countDistinct("site").alias("n_site"), F.countDistinct("modul").alias("n_modul"))


@query("AGG-28", _SIZES + " SELECT round(avg(n), 9) AS avg_size, round(avg(n) FILTER (n >= 2), 9) AS avg_size_ge2, round(count(*) FILTER (n = 1) / count(*), 9) AS singleton_rate FROM s")
def run_rates(spark, sf):
    n = F.col("n")
    return _sizes(spark, sf).agg(F.round(F.avg(n), 9).alias("avg_size"), F.round(F.avg(F.when(n >= 2, n)), 9).alias("avg_size_ge2"), F.round(F.count_if(n == 1) / F.count("*"), 9).alias("singleton_rate"))


@query("AGG-29", _PERMOD + " SELECT modul, count(*) AS n_clusters, round(avg(n), 6) AS avg_size, max(n) AS largest FROM c GROUP BY 1")
def executive(spark, sf):
    return _permod(spark, sf).groupBy("modul").agg(F.count("*").alias("n_clusters"), F.round(F.avg("n"), 6).alias("avg_size"), F.max("n").alias("largest"))


@query("AGG-30", f"WITH {TICKETS}, c AS (SELECT cluster_id, count(*) AS n FROM t GROUP BY 1) SELECT (SELECT count(*) FROM t) AS n_tickets, count(*) AS n_clusters, (SELECT cluster_id FROM c ORDER BY n DESC, cluster_id LIMIT 1) AS top_cluster, max(n) AS top_size FROM c")
def report(spark, sf):
    c = tickets(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("cluster_id")).alias("k")))
    return c.agg(F.sum("n").alias("n_tickets"), F.count("*").alias("n_clusters"), (-best["k"]).alias("top_cluster"), F.max("n").alias("top_size"))


@query("AGG-31", "SELECT source, count(*) FILTER (q IS TRUE) AS n_true, count(*) FILTER (q IS FALSE) AS n_false, round(avg(n_chars), 6) AS avg_chars FROM (SELECT source, n_chars, quality = 1 AS q FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def reviewer_recap(spark, sf):
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("n_true"), F.count_if(F.col("quality") != 1).alias("n_false"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@query("AGG-32", f"WITH {TEXTS}, c AS (SELECT modul, site, count(*) AS n FROM x WHERE site IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY modul ORDER BY n DESC, site) AS r FROM c) SELECT modul, site AS mode_site FROM r WHERE r = 1")
def group_mode(spark, sf):
    c = texts(spark, sf).where("site IS NOT NULL").groupBy("modul", "site").agg(F.count("*").alias("n"))
    return S.latest_per_key(c, ["modul"], [F.desc("n"), F.col("site")]).select("modul", F.col("site").alias("mode_site"))


@query("AGG-33", f"WITH {TICKETS} SELECT strftime(coalesce((SELECT min(ts) FROM t WHERE price < 0), min(ts)), '%Y-%m-%d') AS first_day, strftime(coalesce((SELECT max(ts) FROM t WHERE price < 0), max(ts)), '%Y-%m-%d') AS last_day FROM t")
def time_range(spark, sf):
    a, b = F.coalesce(F.min(F.when(F.col("price") < 0, F.col("ts"))), F.min("ts")), F.coalesce(F.max(F.when(F.col("price") < 0, F.col("ts"))), F.max("ts"))
    return tickets(spark, sf).agg(F.date_format(a, "yyyy-MM-dd").alias("first_day"), F.date_format(b, "yyyy-MM-dd").alias("last_day"))


@query("AGG-35", f"WITH {TICKETS} SELECT count(price) AS n, min(price) AS min, max(price) AS max, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS std, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.5), 4) AS q50, round(quantile_cont(price, 0.75), 4) AS q75, round(quantile_cont(price, 0.9), 4) AS q90, round(quantile_cont(price, 0.95), 4) AS q95, round(quantile_cont(price, 0.99), 4) AS q99 FROM t")
def described(spark, sf):
    return _rounded(S.distribution(tickets(spark, sf), "price"), "mean", "std", "q25", "q50", "q75", "q90", "q95", "q99", places=4)


@query("AGG-37", f"WITH {TICKETS}, m AS (SELECT CAST(year(ts) AS INTEGER) AS y, count(*) AS n FROM t GROUP BY 1) SELECT y, n, n - lag(n) OVER (ORDER BY y) AS delta FROM m")
def marginal(spark, sf):
    m = tickets(spark, sf).groupBy(F.year("ts").alias("y")).agg(F.count("*").alias("n"))
    return S.with_lag_difference(m, "n", "y")


@query("AGG-38", f"WITH {TICKETS}, c AS (SELECT cluster_id, count(*) AS n FROM t WHERE cluster_id % 10 <> 0 GROUP BY 1) SELECT round((SELECT avg(CASE WHEN cluster_id % 10 = 0 THEN 1 ELSE 0 END) FROM t), 9) AS noise_share, n AS size, count(*) AS n_clusters FROM c GROUP BY n")
def noise_chart(spark, sf):
    t = tickets(spark, sf)
    share = t.agg(F.round(F.avg((F.col("cluster_id") % 10 == 0).cast("int")), 9).alias("noise_share"))
    sizes = t.where("cluster_id % 10 <> 0").groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clusters"))
    return sizes.crossJoin(F.broadcast(share))


_STRONG = ", k AS (SELECT cluster_id, no, count(*) AS n FROM e GROUP BY ALL), v AS (SELECT cluster_id, count(*) FILTER (n >= 2) AS nv, CAST(sum(n) AS BIGINT) AS nt FROM k GROUP BY 1)"


@query("AGG-39", _sql([180], more=_STRONG, tail="SELECT round(sum(CASE WHEN nv >= 2 THEN nt ELSE 0 END) / sum(nt), 9) AS share_recurrent, count(*) FILTER (nv >= 2) AS n_strong, count(*) FILTER (nv = 1) AS n_weak FROM v"))
def strong_weak(spark, sf):
    k = _sessions(spark, sf, [180]).groupBy("cluster_id", "temporal_cluster_no").agg(F.count("*").alias("n"))
    v = k.groupBy("cluster_id").agg(F.count_if(F.col("n") >= 2).alias("nv"), F.sum("n").alias("nt"))
    return v.agg(F.round(F.sum(F.when(F.col("nv") >= 2, F.col("nt")).otherwise(0)) / F.sum("nt"), 9).alias("share_recurrent"), F.count_if(F.col("nv") >= 2).alias("n_strong"), F.count_if(F.col("nv") == 1).alias("n_weak"))


@query("AGG-40", _sql([180], more=_LABEL, tail="SELECT count(*) AS n, round(avg(gap), 6) AS mean, median(gap) AS median, round(quantile_cont(gap, 0.9), 6) AS p90 FROM l WHERE y = 1 AND gap IS NOT NULL"))
def gaps(spark, sf):
    return _rounded(S.gap_statistics(_labels(spark, sf)), "mean", "p90")


@query("AGG-41", _sql([180], more=", k AS (SELECT cluster_id, CAST(max(no) AS BIGINT) AS n_episodes, count(*) AS n_members FROM e GROUP BY 1)", tail="SELECT cluster_id, n_episodes, n_members, count(*) OVER (PARTITION BY n_episodes) AS n_alike FROM k ORDER BY n_episodes DESC, n_members DESC, cluster_id LIMIT 20"))
def episode_tops(spark, sf):
    k = _sessions(spark, sf, [180]).groupBy("cluster_id").agg(F.max("temporal_cluster_no").cast("long").alias("n_episodes"), F.count("*").alias("n_members"))
    alike = k.groupBy("n_episodes").agg(F.count("*").alias("n_alike"))
    return k.join(alike, "n_episodes").select("cluster_id", "n_episodes", "n_members", "n_alike").orderBy(F.desc("n_episodes"), F.desc("n_members"), "cluster_id").limit(20)


@query("AGG-43", "SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def pivoted(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("period")).pivot("event_type", ["click", "view", "purchase"]).count().fillna(0)


@query("AGG-44", "SELECT o_orderpriority AS modul, 'avg_price' AS metric, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'n', CAST(count(*) AS DOUBLE) FROM orders GROUP BY 1")
def unpivoted(spark, sf):
    wide = tickets(spark, sf).groupBy("modul").agg(F.round(F.avg("price"), 4).alias("avg_price"), F.count("*").cast("double").alias("n"), F.max(F.when(F.col("price") < 0, F.col("price"))).alias("never"))
    return wide.unpivot("modul", ["avg_price", "n", "never"], "metric", "value").where("value IS NOT NULL")


@query("AGG-45", f"WITH {TICKETS} SELECT cluster_id, strftime(max(ts), '%Y-%m-%d') AS last_day FROM t GROUP BY 1")
def latest(spark, sf):
    return tickets(spark, sf).groupBy("cluster_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("AGG-46", _PERMOD + " SELECT modul, count(*) AS n, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM c GROUP BY modul")
def run_stats(spark, sf):
    n = F.col("n")
    return _permod(spark, sf).groupBy("modul").agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))
