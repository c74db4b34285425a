"""Queries: data sets, models and metrics of recurrence prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprise.catalog.episodes import _LABEL, _labels, _sql
from reprise.catalog.registry import TICKETS, load, query, tickets
from reprise.catalog.spaces import _CENTER, _EMB, _r, _ranked
from reprise.operators import learning as M

_Y = _sql([180], more=_LABEL + ", z AS (SELECT incident_id, cluster_id, ts, site, modul, price, y AS label FROM l)", tail="{}")


def _data(spark, sf):
    return _labels(spark, sf).select("incident_id", "cluster_id", "ts", "site", "modul", "price", F.col("label_berulang").alias("label"))


@query("ML-01", f"WITH {TICKETS} SELECT incident_id, c_mktsegment AS text_col_1, CASE WHEN ts >= TIMESTAMP '2000-01-01' THEN 'test' ELSE 'train' END AS split_name FROM t LEFT JOIN customer ON c_custkey = cluster_id")
def dataset(spark, sf):
    """Two runs are labelled; only the later one is taken."""
    t = tickets(spark, sf)
    runs = t.withColumn("run_time", F.lit(1)).union(t.withColumn("run_time", F.lit(2)))
    names = load(spark, sf, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_mktsegment").alias("text_col_1"))
    return M.supervised(runs, names, key="cluster_id", cutoff="2000-01-01").select("incident_id", "text_col_1", "split_name")


@query("ML-02", f"WITH {TICKETS}, h AS (SELECT incident_id, CASE WHEN incident_id % 10 <> 0 THEN price END AS price, CASE WHEN incident_id % 7 <> 0 THEN site END AS site FROM t) SELECT incident_id, round(coalesce(price, (SELECT median(price) FROM h)), 4) AS price, coalesce(site, (SELECT site FROM h WHERE site IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, site LIMIT 1)) AS site FROM h")
def imputed(spark, sf):
    h = tickets(spark, sf).select("incident_id", F.when(F.col("incident_id") % 10 != 0, F.col("price")).alias("price"), F.when(F.col("incident_id") % 7 != 0, F.col("site")).alias("site"))
    return _r(M.impute(h, ["price"], ["site"]), "price", places=4)


def _fitted(spark, sf, kind):
    rows = _data(spark, sf)
    train, test = rows.where("ts < '2000-01-01'"), rows.where("ts >= '2000-01-01'")
    model = M.pipeline(["price"], ["site", "modul"], kind).fit(M.balance(train, "label"))
    return M.scored(model.transform(test.withColumn("weight", F.lit(1.0))))


@query("ML-03")
def one_hot(spark, sf):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array

    rows = tickets(spark, sf).select("incident_id", "site")
    indexer = StringIndexer(inputCol="site", outputCol="i", handleInvalid="keep").fit(rows.where("site <> 'P'"))
    hot = OneHotEncoder(inputCol="i", outputCol="h", dropLast=True)
    out = hot.fit(indexer.transform(rows)).transform(indexer.transform(rows))
    return out.select("site", F.array_join(F.transform(vector_to_array("h"), lambda x: x.cast("int").cast("string")), "").alias("hot")).distinct()


@query("ML-04", f"WITH {TICKETS} SELECT incident_id, round(price / (SELECT stddev_samp(price) FROM t), 6) AS scaled FROM t")
def scaled(spark, sf):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=["price"], outputCol="v").transform(tickets(spark, sf))
    out = StandardScaler(inputCol="v", outputCol="s", withMean=False).fit(rows).transform(rows)
    return out.select("incident_id", F.round(vector_to_array("s")[0], 6).alias("scaled"))


@query("ML-05")
def text_features(spark, sf):
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").alias("label"))
    model = M.pipeline([], [], "logistic", text="text").fit(M.balance(rows, "label"))
    return M.scored(model.transform(rows.withColumn("weight", F.lit(1.0)))).select("doc_id", F.round("score", 3).alias("score"))


for _id, _kind in (("ML-06", "logistic"), ("ML-07", "forest"), ("ML-08", "svm"), ("ML-09", "boosted")):
    query(_id)(lambda spark, sf, kind=_kind: M.confusion(_fitted(spark, sf, kind), F.col("prediction") == 1).select("tp", "fp", "fn", "tn"))


@query("ML-10")
def crossed(spark, sf):
    """Each row with the prediction of the model that has not seen its fold."""
    rows = _data(spark, sf).select(F.col("incident_id").alias("id"), "site", "price", "label")
    out = M.cross_predict(rows, 5, lambda: M.pipeline(["price"], ["site"], "logistic"))
    return out.select(F.col("id").alias("incident_id"), "label", "fold", F.col("prediction").cast("int").alias("prediction"), F.round("score", 6).alias("score"))


@query("ML-11", _Y.format("SELECT label, count(*) AS n, count(*) FILTER (true) AS n_all FROM z GROUP BY 1"))
def stratified(spark, sf):
    s = M.stratified(_data(spark, sf), "label", {"train": 0.7, "val": 0.15, "test": 0.15}, "incident_id")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("split_name").isin("train", "val", "test")).alias("n_all"))


@query("ML-12", f"WITH {TICKETS} SELECT incident_id, round(1 / (1 + exp(-(price - 250000) / 100000)), 9) AS score FROM t")
def sigmoids(spark, sf):
    return tickets(spark, sf).select("incident_id", F.round(M.sigmoid((F.col("price") - 250000) / 100000), 9).alias("score"))


_CURVE = "WITH q AS (SELECT toxic AS label, round(n_chars / 40000.0, 3) AS score FROM labels JOIN documents USING (doc_id)), g AS (SELECT score, sum(label) AS p, count(*) AS n FROM q GROUP BY 1), c AS (SELECT score, sum(p) OVER o AS tp, sum(n - p) OVER o AS fp FROM g WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), r AS (SELECT score, tp, fp, tp / (tp + fp) AS precision, tp / max(tp) OVER () AS recall, fp / max(fp) OVER () AS fpr FROM c) "


def _curve(spark, sf):
    q = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id").select(F.col("toxic").alias("label"), F.round(F.col("n_chars") / 40000.0, 3).alias("score"))
    return M.curve(q)


@query("ML-13", _CURVE + ", s AS (SELECT recall - coalesce(lag(recall) OVER o, 0) AS dr, precision, fpr - coalesce(lag(fpr) OVER o, 0) AS df, recall + coalesce(lag(recall) OVER o, 0) AS rr FROM r WINDOW o AS (ORDER BY score DESC)) SELECT round(sum(dr * precision), 9) AS average_precision, round(sum(df * rr / 2), 9) AS roc_auc FROM s")
def areas(spark, sf):
    return _r(M.areas(_curve(spark, sf)), "average_precision", "roc_auc")


@query("ML-14", _CURVE + ", f AS (SELECT score, round(2 * precision * recall / (precision + recall + 1e-12), 9) AS f1 FROM r), x AS (SELECT score FROM f ORDER BY f1 DESC, score DESC LIMIT 1), y AS (SELECT score FROM r WHERE precision >= 0.15 ORDER BY recall DESC, score DESC LIMIT 1) SELECT (SELECT score FROM x) AS best_f1, (SELECT score FROM y) AS best_recall")
def thresholds(spark, sf):
    c = _curve(spark, sf)
    return M.choose_threshold(c).select(F.col("score").alias("best_f1")).crossJoin(M.choose_threshold(c, "recall", 0.15).select(F.col("score").alias("best_recall")))


@query("ML-15", "SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn, round(count(*) FILTER (toxic = 1 AND quality = 0) / greatest(count(*) FILTER (quality = 0), 1), 9) AS precision, round(count(*) FILTER (toxic = 1 AND quality = 0) / greatest(count(*) FILTER (toxic = 1), 1), 9) AS recall FROM labels")
def confusions(spark, sf):
    return _r(M.confusion(load(spark, sf, "labels"), F.col("quality") == 0, "toxic").drop("f1"), "precision", "recall")


@query("ML-16", "SELECT toxic, count(*) FILTER (toxic = 1 AND quality = 7) AS tp, CAST(NULL AS DOUBLE) AS precision FROM labels GROUP BY 1")
def null_rates(spark, sf):
    return M.confusion(load(spark, sf, "labels").withColumn("k", F.col("toxic")), F.col("quality") == 7, "toxic", ["k"], null_on_zero=True).select(F.col("k").alias("toxic"), "tp", "precision")


_SWEEP = [round(0.60 + 0.02 * i, 2) for i in range(16)]
_SIM = _EMB + _CENTER + ", gt AS (SELECT vec_id AS id, max(CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END) AS label FROM embeddings GROUP BY 1), s AS (SELECT gt.id, label, round(s, 9) AS sim FROM gt {join} (SELECT id, s FROM ck WHERE r = 1 AND id % 4 <> 0) USING (id)), w AS (SELECT threshold, count(*) FILTER (label = 1 AND {sim} >= threshold) AS tp, count(*) FILTER (label = 0 AND {sim} >= threshold) AS fp, count(*) FILTER (label = 1 AND {sim} < threshold) AS fn, count(*) FILTER (label = 0 AND {sim} < threshold) AS tn FROM s, (SELECT unnest(" + str(_SWEEP) + ") AS threshold) GROUP BY 1) SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall FROM w"


def _sims(spark, sf):
    gt = load(spark, sf, "embeddings").groupBy(F.col("vec_id").alias("id")).agg(F.max((F.col("label") % 2 == 0).cast("int")).alias("label"))
    top = _ranked(spark, sf, 1).where("id % 4 <> 0").select("id", F.round("cosine_sim", 9).alias("sim"))
    return gt.join(top, "id", "left")


@query("ML-17", _SIM.format(join="JOIN", sim="sim"))
def sweep(spark, sf):
    return _r(M.threshold_sweep(_sims(spark, sf), _SWEEP).drop("f1"), "precision", "recall")


@query("ML-18", _SIM.format(join="LEFT JOIN", sim="coalesce(sim, -1)"))
def sweep_all(spark, sf):
    return _r(M.threshold_sweep(_sims(spark, sf), _SWEEP, missing=-1.0).drop("f1"), "precision", "recall")


@query("AGG-36", _EMB + _CENTER + ", k AS (SELECT id, max(s) FILTER (r = 1) AS s1, max(s) FILTER (r = 2) AS s2, max(s) FILTER (r = 3) AS s3, avg(s) AS m, stddev_samp(s) AS d FROM ck WHERE r <= 3 GROUP BY 1) SELECT id, round(s1, 6) AS sim_1, round(s2, 6) AS sim_2, round(s3, 6) AS sim_3, round(m, 6) AS mean_sim, round(d, 6) AS std_sim, round(s1 - s2, 6) AS gap12 FROM k")
def wide(spark, sf):
    return _r(M.top_k_features(_ranked(spark, sf), k=3), "sim_1", "sim_2", "sim_3", "mean_sim", "std_sim", "gap12", places=6)


_HIST = f"WITH {TICKETS}, f AS (SELECT * FROM t WHERE ts < TIMESTAMP '2000-01-01'), g AS (SELECT * FROM t WHERE ts >= TIMESTAMP '2000-01-01'), l2 AS (SELECT cluster_id, modul, avg(price) AS p FROM f GROUP BY ALL), l1 AS (SELECT cluster_id, avg(price) AS p, max(ts) AS last_time FROM f GROUP BY ALL) SELECT incident_id, round(coalesce(l2.p, l1.p, (SELECT avg(price) FROM f)), 7) AS price, coalesce(least({{most}}, greatest(0, date_diff('day', CAST(l1.last_time AS DATE), CAST(g.ts AS DATE)))), 0) AS gap_days FROM g LEFT JOIN l2 ON g.cluster_id = l2.cluster_id AND g.modul = l2.modul LEFT JOIN l1 ON g.cluster_id = l1.cluster_id"


def _history(spark, sf, prefer, most):
    t = tickets(spark, sf).withColumnRenamed("ts", "tgl_submit")
    new, old = t.where("tgl_submit >= '2000-01-01'").drop("price"), t.where("tgl_submit < '2000-01-01'")
    out = M.with_history(new, old, [["cluster_id", "modul"], ["cluster_id"]], ["price"], prefer, most)
    return out.select("incident_id", F.round("price", 7).alias("price"), F.col("gap_days").cast("long").alias("gap_days"))


@query("ML-19", _HIST.format(most=3650))
def history(spark, sf):
    return _history(spark, sf, ("tgl_submit", "event_time"), 3650)


@query("ML-20", _HIST.format(most=365))
def earlier_history(spark, sf):
    return _history(spark, sf, ("event_time", "tgl_submit"), 365)


@query("ML-21", f"WITH {TICKETS} SELECT CASE WHEN ts >= TIMESTAMP '2000-01-01' THEN 'predict' WHEN ts >= TIMESTAMP '1999-01-01' THEN 'holdout' ELSE 'train' END AS part, count(*) AS n, round(avg(isodow(ts) - 1), 6) AS mean_dow FROM t GROUP BY 1")
def parts(spark, sf):
    from reprise.operators.temporal import calendar_features

    part = F.when(F.col("ts") >= "2000-01-01", "predict").when(F.col("ts") >= "1999-01-01", "holdout").otherwise("train")
    return calendar_features(tickets(spark, sf)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("dow"), 6).alias("mean_dow"))


@query("ML-23", _Y.format("SELECT CASE WHEN ts >= TIMESTAMP '2000-01-01' THEN 'test' ELSE 'train' END AS split_name, count(*) AS n, round(avg(label), 9) AS share, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM z GROUP BY 1"))
def class_balance(spark, sf):
    from reprise.operators.temporal import cutoff_split

    d = cutoff_split(_data(spark, sf), "2000-01-01", F.col("ts"))
    return d.groupBy("split_name").agg(F.count("*").alias("n"), F.round(F.avg("label"), 9).alias("share"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))
