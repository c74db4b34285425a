"""Queries: sources, sinks, filters, joins, ranks and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reprise.catalog.registry import ACTIVITY, TEXTS, TICKETS, activity, load, query, texts, tickets
from reprise.operators import relational as R
from reprise.plans.lineage import ensure_checkpoint_dir
from reprise.sources import files as S
from reprise.sources import tables as B


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_T = f"WITH {TICKETS} "


# ---- sources -----------------------------------------------------------------------------------------------------
def _csv(spark, sf, sep, encoding="UTF-8"):
    path = _folder(spark, "csv")
    load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return path


_NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"


@query("SRC-01", _NATION)
def csv_strings(spark, sf):
    return S.read_csv(spark, _csv(spark, sf, ","), ",")


@query("SRC-02", _NATION)
def csv_sniffed(spark, sf):
    return S.read_csv(spark, _csv(spark, sf, ";"))


@query("SRC-03", _NATION)
def csv_counted(spark, sf):
    path = _csv(spark, sf, "|")
    return S.read_csv(spark, path, S.detect_delimiter_by_count(S.sample_bytes(spark, path).decode()))


@query("SRC-04", _NATION)
def csv_encoded(spark, sf):
    path = _csv(spark, sf, ",")
    return S.read_csv(spark, path, ",", S.detect_encoding(S.sample_bytes(spark, path)))


@query("SRC-05", "SELECT 25 AS n_good, 1 AS n_skipped")
def csv_tolerant(spark, sf):
    """The nations and one line of too many fields."""
    path = _folder(spark, "bad")
    n = load(spark, sf, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    spark.createDataFrame([("n_nationkey,n_name",)], "value string").union(n).union(spark.createDataFrame([("1,a,b,c",)], "value string")).coalesce(1).write.text(path)
    good, skipped = S.read_csv_tolerant(spark, path, ["k", "n"])
    kept = good.where(F.expr("try_cast(k AS int) IS NOT NULL")).agg(F.count("*").cast("int").alias("n_good"))
    return kept.crossJoin(skipped.select(F.col("n_skipped").cast("int").alias("n_skipped")))


@query("SRC-07", "SELECT r_regionkey, r_name FROM region")
def whole_table(spark, sf):
    return B.scan(load(spark, sf, "region"), ["r_regionkey", "r_name"])


@query("SRC-08", "SELECT o_orderkey, o_orderstatus FROM orders")
def listed_columns(spark, sf):
    return B.scan(load(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])


@query("SRC-09", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01' AND o_orderstatus = 'F'")
def filtered_scan(spark, sf):
    return B.scan(load(spark, sf, "orders"), ["o_orderkey"], "o_orderdate", "1998-01-01", "1998-06-30", {"o_orderstatus": "F"})


@query("SRC-10", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def newest(spark, sf):
    return B.latest_run(load(spark, sf, "orders"), "o_orderkey", "o_orderdate")


@query("SRC-11", "SELECT r_regionkey, CAST(NULL AS VARCHAR) AS r_comment2 FROM region")
def absent_column(spark, sf):
    r = load(spark, sf, "region")
    return r.select("r_regionkey", B.or_null(r, "r_comment2"))


@query("SRC-12", "SELECT false AS present")
def absent_table(spark, sf):
    return spark.range(1).select(F.lit(B.table_exists(spark, "no_such_table")).alias("present"))


@query("SRC-13", "SELECT unnest(['conversations', 'documents', 'pages']) AS name")
def candidates(spark, sf):
    every = {n: load(spark, sf, n).withColumnRenamed(k, "id") for n, k in (("documents", "doc_id"), ("pages", "page_id"), ("conversations", "conv_id"), ("labels", "doc_id"), ("embeddings", "vec_id"))}
    return spark.createDataFrame([(n,) for n in B.join_candidates(every, "id")], "name string")


@query("SRC-14", "SELECT n_nationkey AS incident_number, n_name AS site FROM nation")
def aliases(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("No Tiket"), F.col("n_name").alias("KANTOR"))
    return S.rename_by_alias(n, {"incident_number": ["no tiket"], "site": ["kantor"]})


@query("SRC-15", "SELECT unnest(['modul', 'site']) AS missing")
def required(spark, sf):
    return spark.createDataFrame([(c,) for c in S.missing_columns(load(spark, sf, "orders"), ["modul", "o_orderkey", "site"])], "missing string")


@query("SRC-16", _T + "SELECT count(*) AS n, count(DISTINCT incident_id) AS n_ids, CAST(sum(hash_site) AS BIGINT) AS n_f FROM (SELECT incident_id, CASE WHEN site = 'F' THEN 1 ELSE 0 END AS hash_site FROM t)")
def shuffled(spark, sf):
    """Columns dealt anew keep their values' counts."""
    s = S.shuffle_columns(tickets(spark, sf), "incident_id", ["site", "modul"])
    return s.agg(F.count("*").alias("n"), F.countDistinct("incident_id").alias("n_ids"), F.sum((F.col("site") == "F").cast("int")).alias("n_f"))


# ---- sinks -------------------------------------------------------------------------------------------------------
def _old_new(spark, sf):
    t = tickets(spark, sf).select("incident_id", "cluster_id", "site", F.lit("old").alias("state"))
    new = tickets(spark, sf).where("incident_id % 7 = 0").select("incident_id", "cluster_id", "site", F.lit("new").alias("state"))
    return t.where("incident_id % 2 = 0"), new


_OLD_NEW = f"WITH {TICKETS}, o AS (SELECT incident_id, cluster_id, site, 'old' AS state FROM t WHERE incident_id % 2 = 0), n AS (SELECT incident_id, cluster_id, site, 'new' AS state FROM t WHERE incident_id % 7 = 0) "


@query("SNK-01", "SELECT r_regionkey, r_name FROM region")
def replaced(spark, sf):
    path = _folder(spark, "table")
    B.write_replacing(load(spark, sf, "nation").select("n_name"), path)
    B.write_replacing(load(spark, sf, "region").select("r_regionkey", "r_name"), path)
    return spark.read.parquet(path)


@query("SNK-02", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def appended(spark, sf):
    path = _folder(spark, "table")
    for _ in range(2):
        B.write_appending(load(spark, sf, "region").select("r_regionkey", "r_name"), path)
    return spark.read.parquet(path)


@query("SNK-03", _OLD_NEW + "SELECT * FROM o WHERE cluster_id NOT IN (SELECT cluster_id FROM n) UNION ALL SELECT * FROM n")
def replaced_by_key(spark, sf):
    return B.replace_by_key(*_old_new(spark, sf), ["cluster_id"])


_UPSERT = _OLD_NEW + "SELECT * FROM o WHERE incident_id NOT IN (SELECT incident_id FROM n) UNION ALL SELECT * FROM n"
for _id in ("SNK-04", "LBL-12", "LBL-14", "ML-22"):
    query(_id, _UPSERT)(lambda spark, sf: B.upsert(*_old_new(spark, sf), ["incident_id"]))


@query("SNK-05", _OLD_NEW + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE incident_id NOT IN (SELECT incident_id FROM o)")
def inserted(spark, sf):
    return B.insert_absent(*_old_new(spark, sf), ["incident_id"])


@query("SNK-06", _T + ", n AS (SELECT cluster_id, TIMESTAMP '2020-01-01' AS ts, 'new' AS state FROM t WHERE cluster_id % 3 = 0 GROUP BY 1), r AS (SELECT cluster_id, ts, 'old' AS state, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, incident_id) AS r FROM t) SELECT state, count(*) AS n FROM (SELECT cluster_id, ts, state FROM r WHERE r > 1 OR cluster_id NOT IN (SELECT cluster_id FROM n) UNION ALL SELECT * FROM n) GROUP BY 1")
def updated_latest(spark, sf):
    old = tickets(spark, sf).select("cluster_id", "ts", F.lit("old").alias("state"))
    new = old.where("cluster_id % 3 = 0").select("cluster_id").distinct().select("cluster_id", F.lit("2020-01-01").cast("timestamp_ntz").alias("ts"), F.lit("new").alias("state"))
    return B.update_latest(old, new, ["cluster_id"], "ts").groupBy("state").agg(F.count("*").alias("n"))


@query("SNK-07", _T + "SELECT incident_id FROM t WHERE cluster_id % 5 <> 0")
def deleted(spark, sf):
    t = tickets(spark, sf)
    return B.delete_by_key(t, t.where("cluster_id % 5 = 0").select("cluster_id"), ["cluster_id"]).select("incident_id")


@query("SNK-08", _NATION)
def csv_written(spark, sf):
    path = _folder(spark, "out")
    B.write_csv(load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return S.read_csv(spark, path, ",")


# ---- filters and projections -------------------------------------------------------------------------------------
@query("FLT-01", _T + "SELECT incident_id FROM t WHERE site = 'O' AND price > 1000 AND ts >= TIMESTAMP '1997-01-01'")
def conditions(spark, sf):
    return B.scan(tickets(spark, sf).where("price > 1000"), ["incident_id"], "ts", "1997-01-01", None, {"site": "O", "modul": None})


def _clustered(spark, sf):
    c = F.when(F.col("cluster_id") % 10 == 0, -1).when(F.col("cluster_id") % 10 != 1, F.col("cluster_id"))
    return tickets(spark, sf).select("incident_id", c.alias("cluster_id"))


_CLUSTERED = f"WITH {TICKETS}, c AS (SELECT incident_id, CASE WHEN cluster_id % 10 = 0 THEN -1 WHEN cluster_id % 10 <> 1 THEN cluster_id END AS cluster_id FROM t) "


@query("FLT-02", _CLUSTERED + "SELECT incident_id FROM c WHERE cluster_id <> -1")
def no_noise(spark, sf):
    return R.without_noise(_clustered(spark, sf)).select("incident_id")


@query("FLT-03", _CLUSTERED + "SELECT incident_id FROM c WHERE cluster_id IS NULL OR cluster_id <> -1")
def no_noise_but_null(spark, sf):
    return R.without_noise(_clustered(spark, sf), null_is_noise=False).select("incident_id")


@query("FLT-04", _T + "SELECT incident_id FROM t WHERE cluster_id IN (SELECT vec_id FROM embeddings)")
def members_of(spark, sf):
    ids = load(spark, sf, "embeddings").select(F.col("vec_id").alias("cluster_id"))
    return tickets(spark, sf).join(ids, "cluster_id", "left_semi").select("incident_id")


@query("FLT-05", f"WITH {TEXTS} SELECT doc_id FROM x WHERE nullif(trim(text), '') IS NOT NULL")
def filled(spark, sf):
    return texts(spark, sf).where(R.not_blank("text")).select("doc_id")


@query("FLT-06", f"WITH {TEXTS} SELECT doc_id FROM x WHERE contains(lower(text), 'license')")
def searched(spark, sf):
    return texts(spark, sf).where(R.contains_ignoring_case("text", "License")).select("doc_id")


@query("FLT-07", _T + "SELECT incident_id FROM t WHERE ts >= TIMESTAMP '1996-02-01' AND ts < TIMESTAMP '1996-03-01'")
def end_of_day(spark, sf):
    return B.scan(tickets(spark, sf), ["incident_id"], "ts", "1996-02-01", "1996-02-29")


@query("FLT-09", _T + ", k AS (SELECT cluster_id, count(*) AS n FROM t GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS clusters_before, CAST(coalesce(sum(n) FILTER (n >= 10), 0) AS BIGINT) AS rows_after, count(*) FILTER (n >= 10) AS clusters_after FROM k")
def small_clusters(spark, sf):
    return R.small_cluster_effect(tickets(spark, sf), 10)


@query("FLT-10", _T + ", k AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM t) SELECT incident_id, CASE WHEN n >= 10 THEN cluster_id ELSE -1 END AS cluster_id, n AS cluster_size, CASE WHEN n >= 10 THEN 1 ELSE 0 END AS is_recurring FROM k")
def noise_policy(spark, sf):
    return R.with_small_clusters_as_noise(tickets(spark, sf), 10).select("incident_id", "cluster_id", "cluster_size", "is_recurring")


@query("FLT-11", _T + "SELECT incident_id, strftime(coalesce(CASE WHEN site = 'F' THEN NULL ELSE ts END, TIMESTAMP '2000-01-01'), '%Y-%m-%d') AS day FROM t")
def first_time(spark, sf):
    t = F.coalesce(F.when(F.col("site") != "F", F.col("ts")), F.lit("2000-01-01").cast("timestamp_ntz"))
    return tickets(spark, sf).select("incident_id", F.date_format(t, "yyyy-MM-dd").alias("day"))


@query("FLT-12", _T + "SELECT incident_id FROM t")
def safe_name(spark, sf):
    return tickets(spark, sf).select(R.identifier("incident_id"))


@query("PRJ-01", _T + "SELECT incident_id AS incident_number, 'run-1' AS job_id, 0.7 AS threshold FROM t")
def run_columns(spark, sf):
    return tickets(spark, sf).select(F.col("incident_id").alias("incident_number"), F.lit("run-1").alias("job_id"), F.lit(0.7).alias("threshold"))


@query("PRJ-02", "SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), -1.0) AS number FROM events")
def numbers(spark, sf):
    return load(spark, sf, "events").select("event_id", R.number_or("event_type", -1.0).alias("number"))


@query("PRJ-03", _T + "SELECT incident_id, CASE WHEN trim(lower(modul)) = '1-urgent' THEN 'TOP' WHEN contains(lower(modul), 'low') THEN 'LOW' ELSE upper(trim(modul)) END AS kind FROM t")
def kinds(spark, sf):
    return tickets(spark, sf).select("incident_id", R.harmonized(F.col("modul"), {"1-urgent": "TOP"}, {"low": "LOW"}).alias("kind"))


# ---- joins -------------------------------------------------------------------------------------------------------
@query("JN-01", _T + ", e AS (SELECT cluster_id FROM t GROUP BY 1 HAVING count(*) >= 12) SELECT incident_id FROM t JOIN e USING (cluster_id)")
def eligible_join(spark, sf):
    t = tickets(spark, sf)
    e = t.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n >= 12").select("cluster_id")
    return t.join(e, "cluster_id").select("incident_id")


@query("JN-02", _T + ", e AS (SELECT cluster_id, site, modul FROM t GROUP BY ALL HAVING count(*) >= 3) SELECT incident_id FROM t JOIN e USING (cluster_id, site, modul)")
def three_keys(spark, sf):
    t = tickets(spark, sf)
    e = t.groupBy("cluster_id", "site", "modul").agg(F.count("*").alias("n")).where("n >= 3").drop("n")
    return t.join(e, ["cluster_id", "site", "modul"]).select("incident_id")


@query("JN-03", "SELECT doc_id, quality, lang FROM documents LEFT JOIN labels USING (doc_id)")
def metadata(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "lang").join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "quality", "lang")


@query("JN-04", _T + "SELECT incident_id, count(*) OVER (PARTITION BY cluster_id) AS n_cluster, count(*) OVER (PARTITION BY cluster_id, modul) AS n_part FROM t")
def three_way(spark, sf):
    from pyspark.sql import Window as W

    return tickets(spark, sf).select("incident_id", F.count("*").over(W.partitionBy("cluster_id")).alias("n_cluster"), F.count("*").over(W.partitionBy("cluster_id", "modul")).alias("n_part"))


@query("JN-05", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def not_yet(spark, sf):
    return load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("JN-06", "SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def already(spark, sf):
    return load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id")


_AB = _T + ", a AS (SELECT incident_id, modul AS cluster FROM t), b AS (SELECT incident_id, site AS cluster FROM t) "


def _ab(spark, sf):
    t = tickets(spark, sf)
    return t.select("incident_id", F.col("modul").alias("cluster")), t.select("incident_id", F.col("site").alias("cluster"))


@query("JN-07", _AB + "SELECT a.cluster AS cluster_a, b.cluster AS cluster_b, count(*) AS n FROM a JOIN b USING (incident_id) GROUP BY ALL")
def overlap_matrix(spark, sf):
    return R.overlap(*_ab(spark, sf))


@query("JN-08", _AB + "SELECT incident_id FROM a JOIN b USING (incident_id) WHERE a.cluster = '1-URGENT' AND b.cluster = 'O'")
def overlap_members(spark, sf):
    a, b = _ab(spark, sf)
    return a.where("cluster = '1-URGENT'").join(b.where("cluster = 'O'"), "incident_id").select("incident_id")


@query("JN-09", _T + ", p AS (SELECT cluster_id, count(*) AS n_f FROM t WHERE site = 'F' GROUP BY 1), q AS (SELECT cluster_id, count(*) AS n_o FROM t WHERE site = 'O' GROUP BY 1) SELECT coalesce(p.cluster_id, q.cluster_id) AS cluster_id, n_f, n_o FROM p FULL JOIN q ON p.cluster_id = q.cluster_id")
def outer(spark, sf):
    t = tickets(spark, sf)
    p, q = t.where("site = 'F'").groupBy("cluster_id").agg(F.count("*").alias("n_f")), t.where("site = 'O'").groupBy("cluster_id").agg(F.count("*").alias("n_o"))
    return p.join(q, "cluster_id", "full")


@query("JN-10", _T + ", f AS (SELECT * FROM t WHERE ts < TIMESTAMP '1996-01-01'), g AS (SELECT * FROM t WHERE ts >= TIMESTAMP '2001-06-01'), l3 AS (SELECT cluster_id, modul, site, avg(price) AS p FROM f GROUP BY ALL), l2 AS (SELECT cluster_id, modul, avg(price) AS p FROM f GROUP BY ALL), l1 AS (SELECT cluster_id, avg(price) AS p FROM f GROUP BY ALL) SELECT incident_id, CASE WHEN l3.p IS NOT NULL THEN 3 WHEN l2.p IS NOT NULL THEN 2 WHEN l1.p IS NOT NULL THEN 1 ELSE 0 END AS level, round(coalesce(l3.p, l2.p, l1.p, (SELECT avg(price) FROM f)), 4) AS price FROM g LEFT JOIN l3 ON g.cluster_id = l3.cluster_id AND g.modul = l3.modul AND g.site = l3.site LEFT JOIN l2 ON g.cluster_id = l2.cluster_id AND g.modul = l2.modul LEFT JOIN l1 ON g.cluster_id = l1.cluster_id")
def fallback(spark, sf):
    t = tickets(spark, sf)
    out = R.with_fallback(t.where("ts >= '2001-06-01'").drop("price"), t.where("ts < '1996-01-01'"), [["cluster_id", "modul", "site"], ["cluster_id", "modul"], ["cluster_id"]], ["price"])
    return out.select("incident_id", "level", F.round("price", 4).alias("price"))


@query("JN-11", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def lookup(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey").join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left").select("o_orderkey", "c_mktsegment")


@query("JN-12", "SELECT o_orderkey, count(*) AS n_terms FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1")
def vectors_of(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    return o.join(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n_terms"))


@query("JN-13", "SELECT count(*) AS n_members, count(vec_id) AS n_joined, round(100.0 * count(vec_id) / count(*), 6) AS join_rate FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def join_rate(spark, sf):
    d = load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id"), "doc_id", "left")
    return d.agg(F.count("*").alias("n_members"), F.count("vec_id").alias("n_joined"), F.round(F.count("vec_id") * 100 / F.count("*"), 6).alias("join_rate"))


# ---- windows, sorts, sets ----------------------------------------------------------------------------------------
def _w(spark, sf, expression, name):
    return tickets(spark, sf).select("incident_id", F.expr(expression).alias(name))


for _id, _spark, _duck, _name in (
    ("WIN-01", "date_format(lag(ts) OVER (PARTITION BY cluster_id ORDER BY ts, incident_id), 'yyyy-MM-dd')", "strftime(lag(ts) OVER (PARTITION BY cluster_id ORDER BY ts, incident_id), '%Y-%m-%d')", "previous"),
    ("WIN-02", "sum(CASE WHEN site = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id ORDER BY ts, incident_id ROWS UNBOUNDED PRECEDING) + 1", None, "running"),
    ("WIN-05", "count(*) OVER (PARTITION BY cluster_id)", None, "group_size"),
):
    query(_id, _T + f"SELECT incident_id, CAST({_duck or _spark} AS {'VARCHAR' if _duck else 'BIGINT'}) AS {_name} FROM t")(lambda spark, sf, e=_spark, n=_name: _w(spark, sf, e, n))


@query("WIN-03", _T + ", r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, modul ORDER BY ts, incident_id) AS r FROM t) SELECT cluster_id, modul, incident_id FROM r WHERE r = 1")
def one_each(spark, sf):
    return R.first_per_key(tickets(spark, sf), ["cluster_id", "modul"], [F.col("ts"), F.col("incident_id")]).select("cluster_id", "modul", "incident_id")


@query("WIN-04", _T + ", r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC NULLS LAST, incident_id) AS r FROM t) SELECT cluster_id, incident_id FROM r WHERE r = 1")
def distinct_on(spark, sf):
    return R.first_per_key(tickets(spark, sf), ["cluster_id"], [F.col("ts").desc_nulls_last(), F.col("incident_id")]).select("cluster_id", "incident_id")


@query("WIN-06", _AB + ", o AS (SELECT a.cluster AS cluster_a, b.cluster AS cluster_b, count(*) AS n FROM a JOIN b USING (incident_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_a ORDER BY n DESC, cluster_b) AS r FROM o) SELECT cluster_a, cluster_b, n FROM r WHERE r = 1")
def dominant(spark, sf):
    return R.first_per_key(R.overlap(*_ab(spark, sf)), ["cluster_a"], [F.desc("n"), F.col("cluster_b")])


@query("WIN-07", _T + ", r AS (SELECT *, row_number() OVER (PARTITION BY modul ORDER BY price DESC NULLS LAST, ts DESC NULLS LAST, incident_id) AS r FROM t) SELECT modul, incident_id FROM r WHERE r = 1")
def best_run(spark, sf):
    return R.first_per_key(tickets(spark, sf), ["modul"], [F.col("price").desc_nulls_last(), F.col("ts").desc_nulls_last(), F.col("incident_id")]).select("modul", "incident_id")


@query("WIN-08", _T + ", m AS (SELECT modul, CAST(year(ts) AS INTEGER) AS y, count(*) AS n FROM t GROUP BY ALL) SELECT modul, y, n - lag(n) OVER (PARTITION BY modul ORDER BY y) AS delta FROM m")
def difference(spark, sf):
    from reprise.operators.stats import with_lag_difference

    m = tickets(spark, sf).groupBy("modul", F.year("ts").alias("y")).agg(F.count("*").alias("n"))
    return with_lag_difference(m, "n", "y", ["modul"]).select("modul", "y", "delta")


@query("SRT-01", _T + "SELECT incident_id FROM t ORDER BY site, price DESC NULLS LAST, incident_id LIMIT 50")
def sorted_rows(spark, sf):
    return tickets(spark, sf).orderBy(F.col("site").asc_nulls_last(), F.col("price").desc_nulls_last(), "incident_id").limit(50).select("incident_id")


@query("SRT-02", _T + "SELECT incident_id FROM t ORDER BY incident_id LIMIT 20 OFFSET 40")
def paged(spark, sf):
    return R.page(tickets(spark, sf), [F.col("incident_id")], 3, 20).select("incident_id")


@query("SRT-03", _T + ", r AS (SELECT *, row_number() OVER (PARTITION BY modul ORDER BY price DESC, incident_id) AS r FROM t) SELECT modul, incident_id FROM r WHERE r <= 5")
def top_k(spark, sf):
    return R.first_per_key(tickets(spark, sf), ["modul"], [F.desc("price"), F.col("incident_id")], 5).select("modul", "incident_id")


@query("SRT-04", "SELECT 100 AS n, 100 AS n_ids")
def drawn(spark, sf):
    return R.sample_rows(tickets(spark, sf), 100, "incident_id").agg(F.count("*").cast("int").alias("n"), F.countDistinct("incident_id").cast("int").alias("n_ids"))


@query("SRT-05", _T + "SELECT modul, least(count(*), 7) AS n FROM t GROUP BY 1")
def strata(spark, sf):
    return R.sample_strata(tickets(spark, sf), ["modul"], 7, "incident_id").groupBy("modul").agg(F.count("*").alias("n"))


@query("SRT-06", _CLUSTERED + ", k AS (SELECT DISTINCT cluster_id FROM c WHERE cluster_id IS NOT NULL) SELECT cluster_id FROM k ORDER BY cluster_id = -1, cluster_id LIMIT 12")
def labelled_order(spark, sf):
    return _clustered(spark, sf).where("cluster_id IS NOT NULL").select("cluster_id").distinct().orderBy(*R.cluster_order()).limit(12)


@query("SRT-07", _T + ", k AS (SELECT modul, cluster_id, count(*) AS n FROM t GROUP BY ALL) SELECT modul, CAST(sum(least(n, 2)) AS BIGINT) AS n FROM k GROUP BY 1")
def capped(spark, sf):
    return R.sample_strata(tickets(spark, sf), ["modul", "cluster_id"], 2, "incident_id").groupBy("modul").agg(F.count("*").alias("n"))


_SETS = _T + ", f AS (SELECT cluster_id FROM t WHERE site = 'F'), o AS (SELECT cluster_id FROM t WHERE site = 'O') "


def _sets(spark, sf):
    t = tickets(spark, sf)
    return [t.where(F.col("site") == s).select("cluster_id") for s in "FO"]


@query("SET-01", _SETS + "SELECT * FROM f UNION ALL SELECT * FROM o")
def union_all(spark, sf):
    a, b = _sets(spark, sf)
    return a.unionByName(b)


@query("SET-02", _SETS + "SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM f INTERSECT SELECT * FROM o) UNION ALL SELECT 'only', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM o)")
def set_parts(spark, sf):
    a, b = _sets(spark, sf)
    count = lambda d, n: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return count(a.intersect(b), "both").union(count(a.subtract(b), "only"))


@query("SET-03", _SETS + "SELECT * FROM f INTERSECT SELECT * FROM o")
def common(spark, sf):
    a, b = _sets(spark, sf)
    return a.intersect(b)


@query("SET-04", _T + "SELECT DISTINCT site, modul FROM t")
def distinct_keys(spark, sf):
    return tickets(spark, sf).select("site", "modul").distinct()


@query("SET-05", f"WITH {ACTIVITY}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, modul ORDER BY ts, incident_id) AS r FROM a) SELECT incident_id FROM r WHERE r = 1")
def keep_first(spark, sf):
    return R.first_per_key(activity(spark, sf), ["cluster_id", "modul"], [F.col("ts"), F.col("incident_id")]).select("incident_id")
