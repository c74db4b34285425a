"""Queries: vectors, similarity, clusters and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprise.catalog.registry import TEXTS, TICKETS, load, query, texts, tickets
from reprise.operators import density as D
from reprise.operators import evaluation as E
from reprise.operators import similarity as S
from reprise.operators import stats as A
from reprise.operators import vectors as V
from reprise.operators.textpairs import text_pairs


def _tokens(spark, sf):
    return texts(spark, sf).select("doc_id", "modul", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), 0).alias("tokens"))


_TF = f"""WITH {TEXTS}, w AS (SELECT doc_id, modul, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws FROM x),
f AS (SELECT doc_id, term, count(*) AS tf, any_value(k) AS k FROM (SELECT doc_id, unnest(ws) AS term, len(ws) AS k FROM w) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM w),
v AS (SELECT term, count(*) AS df, sum(tf) AS total, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM f, n GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.5 * any_value(n))
"""


def _r(df, *columns, places=9):
    return df.withColumns({c: F.round(c, places) for c in columns})


def _digest(df):
    return df.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight"))


_DIGEST = "SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS weight FROM g GROUP BY 1"


@query("VEC-01", _TF + "SELECT doc_id, count(*) AS n_terms, round(sum(tf / k * length(term)), 8) AS tf FROM f GROUP BY 1")
def normalised_tf(spark, sf):
    t = V.term_frequencies(_tokens(spark, sf))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.sum(F.col("tf") / F.col("n_tokens") * F.length("term")), 8).alias("tf"))


@query("VEC-02", _TF + "SELECT term, df, round(idf, 9) AS idf FROM v")
def smoothed_idf(spark, sf):
    t = _tokens(spark, sf)
    return _r(V.vocabulary(V.term_frequencies(t), t.count(), 3, 0.5), "idf")


@query("VEC-03", _TF + "SELECT term, df FROM v ORDER BY total DESC, term LIMIT 500")
def pruned(spark, sf):
    t = _tokens(spark, sf)
    return V.vocabulary(V.term_frequencies(t), t.count(), 3, 0.5, 500).select("term", "df")


@query("VEC-04", _TF + ", g AS (SELECT doc_id, term, tf / k * idf AS weight FROM f JOIN v USING (term)) " + _DIGEST)
def weights(spark, sf):
    return _digest(V.tfidf(_tokens(spark, sf), 3, 0.5))


@query("VEC-05", _TF + ", h AS (SELECT doc_id, term, tf * idf AS w FROM f JOIN v USING (term)), g AS (SELECT doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM h) " + _DIGEST)
def unit_weights(spark, sf):
    return _digest(V.tfidf(_tokens(spark, sf), 3, 0.5, norm="l2", relative=False))


@query("VEC-06", _TF + ", h AS (SELECT doc_id, term, tf * idf AS w FROM f JOIN v USING (term)), g AS (SELECT doc_id, w / sum(abs(w)) OVER (PARTITION BY doc_id) AS weight FROM h) " + _DIGEST)
def raw_variant(spark, sf):
    return _digest(V.tfidf(_tokens(spark, sf), 3, 0.5, norm="l1", relative=False))


@query("VEC-07", _TF + ", h AS (SELECT doc_id, term, tf * idf AS w FROM f JOIN v USING (term)), g AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM h), m AS (SELECT term, sum(weight) / (SELECT n FROM n) AS mean_score FROM g GROUP BY 1) SELECT term, round(mean_score, 9) AS mean_score FROM m ORDER BY round(mean_score, 9) DESC, term LIMIT 30")
def top_mean(spark, sf):
    t = _tokens(spark, sf)
    n = t.count()
    m = V.tfidf(t, 3, 0.5, norm="l2", relative=False).groupBy("term").agg(F.round(F.sum("weight") / n, 9).alias("mean_score"))
    return m.orderBy(F.desc("mean_score"), "term").limit(30)


@query("VEC-08", _TF + ", g AS (SELECT doc_id, (1 + ln(tf)) * idf AS weight FROM f JOIN v USING (term)) " + _DIGEST)
def sublinear(spark, sf):
    return _digest(V.tfidf(_tokens(spark, sf), 3, 0.5, sublinear=True))


_MOD = f"WITH {TEXTS}, w AS (SELECT doc_id, modul, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws FROM x), n AS (SELECT modul, count(*) AS n_docs FROM w GROUP BY 1), d AS (SELECT modul, term, count(*) AS df FROM (SELECT DISTINCT modul, doc_id, unnest(ws) AS term FROM w) GROUP BY ALL) "


@query("VEC-09", _MOD + "SELECT modul, term, n_docs, df, round(df / n_docs, 9) AS df_ratio, round(ln((1 + n_docs) / (1 + df)) + 1, 9) AS idf FROM d JOIN n USING (modul) WHERE df >= 5")
def per_module(spark, sf):
    return _r(V.module_features(_tokens(spark, sf)).where("df >= 5"), "df_ratio", "idf")


@query("VEC-10", _MOD + "SELECT modul, count(*) AS n_features FROM d GROUP BY 1")
def features(spark, sf):
    return V.module_features(_tokens(spark, sf)).groupBy("modul").agg(F.count("*").alias("n_features"))


_EMB = "WITH e AS (SELECT vec_id AS id, label AS cluster_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT id, cluster_id, v, CASE WHEN sqrt(list_inner_product(v, v)) > 0 THEN list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) ELSE v END AS u FROM e) "


def _emb(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("vector"))


@query("VEC-11", _EMB + "SELECT id, round(u[1], 9) AS first, round(list_inner_product(u, u), 6) AS size FROM u")
def unit_rows(spark, sf):
    e = E.normalized(_emb(spark, sf))
    return e.select("id", F.round(F.col("vector")[0], 9).alias("first"), F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("size"))


@query("VEC-12", "SELECT vec_id AS id, 64 AS dim FROM embeddings WHERE vec_id % 5 <> 0")
def parsed(spark, sf):
    rows = _emb(spark, sf).select("id", F.when(F.col("id") % 5 == 0, F.lit("[1.0, oops")).otherwise(F.to_json("vector")).alias("vector"))
    return V.parse_vectors(rows, "vector").select("id", F.size("vector").alias("dim"))


@query("VEC-13", _TF + "SELECT doc_id, term, round(tf / k, 9) AS tf, round(idf, 9) AS idf, round(tf / k * idf, 9) AS weight FROM f JOIN v USING (term) WHERE starts_with(term, 'wor')")
def tables(spark, sf):
    return _r(V.tfidf(_tokens(spark, sf), 3, 0.5).where(F.col("term").startswith("wor")), "tf", "idf", "weight")


@query("VEC-14", _TF + ", k AS (SELECT term FROM v ORDER BY df DESC, term LIMIT 20) SELECT doc_id, count(*) AS n_kept FROM f JOIN k USING (term) GROUP BY 1")
def frequent_terms(spark, sf):
    t = _tokens(spark, sf)
    tf = V.term_frequencies(t)
    top = V.vocabulary(tf, t.count(), 3, 0.5).orderBy(F.desc("df"), "term").limit(20).select("term")
    return tf.join(F.broadcast(top), "term").groupBy("doc_id").agg(F.count("*").alias("n_kept"))


@query("VEC-15")
def embedded(spark, sf):
    e = V.embed(load(spark, sf, "documents"), V.hashed_model(64), 64)
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("size"))


@query("VEC-16", _EMB + ", c AS (SELECT cluster_id, i, avg(v[i]) AS m FROM e, unnest(range(1, 65)) AS t(i) GROUP BY ALL) SELECT cluster_id, round(sum(m * i), 6) AS weighted, (SELECT count(*) FROM e WHERE e.cluster_id = c.cluster_id) AS n, (SELECT min(id) FROM e WHERE e.cluster_id = c.cluster_id) AS representative FROM c GROUP BY cluster_id")
def centers(spark, sf):
    c = V.centroids(_emb(spark, sf))
    weighted = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return c.select("cluster_id", F.round(weighted, 6).alias("weighted"), "n", "representative")


query("VEC-17")(lambda spark, sf: V.principal_components(_emb(spark, sf), "vector", 2).select("id", F.round(F.abs(F.col("pca")[0]), 6).alias("pc1")))
query("VEC-18")(lambda spark, sf: V.truncated_svd(_emb(spark, sf), "vector", 3).select("id", F.round(F.abs(F.col("svd")[0]), 6).alias("sv1")))

_COS = _EMB + ", p AS (SELECT a.id AS a, b.id AS b, least(list_inner_product(a.u, b.u), 1.0) AS sim FROM u a JOIN u b ON a.id < b.id) "
_NEAR = _COS + ", s AS (SELECT * FROM p WHERE sim >= 0.5 - 1e-9), b AS (SELECT a AS id, b AS o, sim FROM s UNION ALL SELECT b, a, sim FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, o) AS r FROM b) "


def _pairs(spark, sf, t=0.5):
    return S.dense_pairs(_emb(spark, sf).select("id", "vector"), t)


@query("JN-14", _TF + ", h AS (SELECT doc_id, term, tf / k * idf AS w FROM f JOIN v USING (term)), g AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM h) SELECT p.doc_id AS a, q.doc_id AS b, round(sum(p.w * q.w), 6) AS sim FROM g p JOIN g q ON p.term = q.term AND p.doc_id < q.doc_id GROUP BY ALL HAVING sum(p.w * q.w) >= 0.8 - 1e-9")
def similar_texts(spark, sf):
    return _r(text_pairs(_tokens(spark, sf), 0.8, 3, 0.5), "sim", places=6)


@query("JN-15", _NEAR + "SELECT id, o AS neighbour, round(sim, 9) AS sim, CAST(r AS INTEGER) AS rank FROM k WHERE r <= 10")
def nearest(spark, sf):
    return _r(S.top_k(_pairs(spark, sf), 10), "sim")


@query("JN-16", _COS + "SELECT a, b, round(sim, 9) AS sim FROM p WHERE 1 - sim <= 0.4 + 1e-9")
def radius(spark, sf):
    return _r(_pairs(spark, sf, 0.6), "sim")


_DAY = ", d AS (SELECT o_orderkey AS id, o_orderdate AS ts FROM orders) "


@query("JN-17", _NEAR + ", d AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, o_orderdate AS ts FROM orders) SELECT k.id AS src, k.o AS dst FROM k JOIN d x ON x.id = k.id JOIN d y ON y.id = k.o WHERE r <= 10 AND abs(date_diff('day', CAST(x.ts AS DATE), CAST(y.ts AS DATE))) <= 400")
def near_in_time(spark, sf):
    """The i-th order lends its time to vector i: ids are dense keys of the orders, ranked over the few that vectors have."""
    from pyspark.sql import Window as W

    n = _emb(spark, sf).count()
    few = tickets(spark, sf).select("incident_id", "ts").orderBy("incident_id").limit(n)
    times = few.select((F.row_number().over(W.orderBy("incident_id")) - 1).cast("long").alias("id"), "ts")
    return S.within_days(S.knn_edges(_pairs(spark, sf), 10, 0.5), times, 400).select("src", "dst")


@query("JN-18", _EMB + ", q AS (SELECT u AS q FROM u WHERE id = 7) SELECT id, round(list_inner_product(u, q), 9) AS sim FROM u, q ORDER BY round(list_inner_product(u, q), 12) DESC, id LIMIT 10")
def one_against_all(spark, sf):
    e = _emb(spark, sf)
    return _r(S.search(e, e.where("id = 7").first()["vector"], 10), "sim")


_CENTER = ", cc AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(v[i]) AS m FROM e, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY 1), cu AS (SELECT cluster_id, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM cc), ck AS (SELECT u.id, cu.cluster_id, list_inner_product(u.u, cu.c) AS s, row_number() OVER (PARTITION BY u.id ORDER BY round(list_inner_product(u.u, cu.c), 12) DESC, cu.cluster_id) AS r FROM u, cu) "


def _ranked(spark, sf, k=3):
    e = _emb(spark, sf)
    return V.nearest_centroids(e.select("id", "vector"), V.centroids(e).select("cluster_id", "centroid"), k)


@query("JN-19", _EMB + _CENTER + "SELECT id, CAST(r AS INTEGER) AS topk_rank, cluster_id, round(s, 6) AS cosine_sim FROM ck WHERE r <= 3")
def to_centroids(spark, sf):
    return _r(_ranked(spark, sf), "cosine_sim", places=6)


@query("LBL-11", _EMB + _CENTER + ", z AS (SELECT ck.cluster_id, ck.id, row_number() OVER (PARTITION BY ck.cluster_id ORDER BY round(s, 9) DESC, ck.id) AS z FROM ck JOIN u USING (id) WHERE u.cluster_id = ck.cluster_id) SELECT cluster_id, id FROM z WHERE z = 1")
def representative(spark, sf):
    from reprise.operators.relational import first_per_key

    own = _emb(spark, sf).select("id", "cluster_id")
    s = _ranked(spark, sf, 1000).join(own, ["id", "cluster_id"])
    return first_per_key(s, ["cluster_id"], [F.round("cosine_sim", 9).desc(), F.col("id")]).select("cluster_id", "id")


_TOPIC = _TF + ", g AS (SELECT doc_id, term, tf / k * idf AS weight FROM f JOIN v USING (term)), m AS (SELECT modul AS cluster_id, count(*) AS n FROM w GROUP BY 1), s AS (SELECT modul AS cluster_id, term, sum(weight) AS score FROM g JOIN w USING (doc_id) GROUP BY ALL), r AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, term) AS rank, term, score FROM s) "


def _topic_sums(spark, sf):
    t = _tokens(spark, sf)
    return V.tfidf(t, 3, 0.5).join(t.select("doc_id", F.col("modul").alias("cluster_id")), "doc_id").groupBy("cluster_id", "term").agg(F.sum("weight").alias("score"))


@query("LBL-09", _TOPIC + "SELECT cluster_id, CAST(rank AS INTEGER) AS rank, term, round(score, 6) AS score FROM r WHERE rank <= 10")
def topic_sums(spark, sf):
    from reprise.operators.labeling import top_terms

    return _r(top_terms(_topic_sums(spark, sf), 10), "score", places=6)


@query("LBL-10", _TOPIC + "SELECT cluster_id, term, round(score / n, 6) AS score FROM r JOIN m USING (cluster_id) WHERE rank <= 12 AND score > 0")
def topic_means(spark, sf):
    from reprise.operators.labeling import top_terms

    n = texts(spark, sf).groupBy(F.col("modul").alias("cluster_id")).agg(F.count("*").alias("n"))
    best = top_terms(_topic_sums(spark, sf).where("score > 0"), 12).join(n, "cluster_id")
    return best.select("cluster_id", "term", F.round(F.col("score") / F.col("n"), 6).alias("score"))


@query("AGG-42", _TF + ", d AS (SELECT term, df FROM v ORDER BY df DESC, term LIMIT 30) SELECT term, df FROM d")
def document_frequency(spark, sf):
    maps = V.as_maps(V.tfidf(_tokens(spark, sf), 3, 0.5))
    per = maps.select(F.explode(F.map_keys("vector")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return per.orderBy(F.desc("df"), "term").limit(30)


@query("AGG-34", _NEAR + "SELECT count(*) AS n, round(min(sim), 6) AS min, round(max(sim), 6) AS max, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std, round(quantile_cont(sim, 0.5), 6) AS q50, round(quantile_cont(sim, 0.9), 6) AS q90 FROM k WHERE r <= 10")
def similarity_distribution(spark, sf):
    d = A.distribution(S.top_k(_pairs(spark, sf), 10), "sim", (0.5, 0.9))
    return _r(d, "min", "max", "mean", "std", "q50", "q90", places=6)


@query("EVC-11", _NEAR + "SELECT CAST(least(50, floor(sim * 50) + 1) AS INTEGER) AS bin, count(*) AS n FROM k WHERE r <= 10 GROUP BY 1")
def similarity_histogram(spark, sf):
    return A.unit_histogram(S.top_k(_pairs(spark, sf), 10), "sim")


@query("SIM-01", _COS + "SELECT count(*) AS n, round(avg(sim), 6) AS mean FROM p WHERE a % 2 = 0 AND b = a + 1")
def sampled_pairs(spark, sf):
    """Neighbouring ids stand for the random pairs, which no SQL can redraw."""
    e = E.normalized(_emb(spark, sf))
    a, b = e.where("id % 2 = 0").select(F.col("id").alias("k"), F.col("vector").alias("x")), e.where("id % 2 = 1").select((F.col("id") - 1).alias("k"), F.col("vector").alias("y"))
    return a.join(b, "k").agg(F.count("*").alias("n"), F.round(F.avg(V.dot(F.col("x"), F.col("y"))), 6).alias("mean"))


@query("SIM-02", _COS + "SELECT count(*) AS n, round(avg(sim), 6) AS mean FROM p WHERE a < 100 AND b < 100")
def block_pairs(spark, sf):
    """The upper triangle of a block of rows; the block is the feature."""
    return S.dense_pairs(_emb(spark, sf).where("id < 100").select("id", "vector"), -1.0).agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("mean"))


@query("SIM-03", _COS + "SELECT a, b, round(sim, 9) AS sim FROM p WHERE sim >= 0.6 - 1e-9 ORDER BY round(sim, 9) DESC, a, b LIMIT 5000")
def listed_pairs(spark, sf):
    return _r(_pairs(spark, sf, 0.6), "sim").orderBy(F.desc("sim"), "a", "b").limit(5000)


@query("SIM-04", _COS + "SELECT t AS threshold, count(b) AS n_pairs, round(avg(sim), 6) AS mean_sim, count(DISTINCT a) AS n_anchors FROM (SELECT unnest([0.5, 0.6, 0.7, 0.99]) AS t) LEFT JOIN p ON sim >= t - 1e-9 GROUP BY t")
def coverage(spark, sf):
    return _r(S.threshold_coverage(_pairs(spark, sf), [0.5, 0.6, 0.7, 0.99]), "mean_sim", places=6)


_KNN = "SELECT id AS src, o AS dst FROM k WHERE r <= 10 AND sim >= 0.6 - 1e-9"


def _graph(spark, sf, k=10, t=0.6, least=1):
    return S.cluster_by_graph(_emb(spark, sf), S.knn_edges(_pairs(spark, sf), k, t), least)


for _id in ("CLU-01", "CLU-02", "CLU-07"):
    query(_id)(lambda spark, sf: _graph(spark, sf))
query("CLU-03")(lambda spark, sf: _graph(spark, sf, 5))
query("CLU-06")(lambda spark, sf: _graph(spark, sf, 10, 0.6, 5))


@query("CLU-04")
def segments(spark, sf):
    """Texts of one module that are alike, numbered by size within the module."""
    t = _tokens(spark, sf)
    edges = S.sparse_pairs(V.tfidf(t, 3, 0.5, keep=("modul",)), 0.7, ["modul"], forest=True).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    members = S.cluster_by_graph(t.select(F.col("doc_id").alias("id")), edges).join(t.select(F.col("doc_id").alias("id"), "modul"), "id")
    return S.ranked_by_size(members, ["modul"]).select("id", "modul", "label")


@query("CLU-05")
def adaptive(spark, sf):
    k = S.adaptive_k(_emb(spark, sf).count(), 10)
    return _graph(spark, sf, k, 0.6)


for _id, _leaf in (("CLU-08", False), ("CLU-09", True)):
    query(_id)(lambda spark, sf, leaf=_leaf: _r(D.cluster_density(_emb(spark, sf).select("id", "vector"), 10, metric="cosine", leaf=leaf), "prob", "outlier_score", places=6))


@query("CLU-10")
def k_means(spark, sf):
    return S.kmeans(_emb(spark, sf).select("id", "vector"), 10).select("id", "cluster_id")


@query("CLU-11")
def k_scan(spark, sf):
    rows = _emb(spark, sf).select("id", "vector")
    out = None
    for k in (5, 10):
        one = E.cosine_silhouette(S.kmeans(rows, k)).select(F.lit(k).alias("k"), F.round("silhouette", 6).alias("silhouette"))
        out = one if out is None else out.union(one)
    return out


@query("CLU-12")
def sensitivity(spark, sf):
    """Cluster and singleton counts for several k, over one table of neighbours."""
    from reprise.plans.lineage import cut

    pairs = cut(_pairs(spark, sf, 0.5))
    out = None
    for k in (5, 10, 20):
        c = S.cluster_by_graph(_emb(spark, sf), S.knn_edges(pairs, k, 0.6)).groupBy("cluster_id").agg(F.count("*").alias("n"))
        one = A.size_distribution(c).select(F.lit(k).alias("k"), "n_clusters", "n_singletons", "max_size")
        out = one if out is None else out.union(one)
    return out


@query("CLU-13", _NEAR + ", d AS (" + _KNN + "), z AS (SELECT src AS id, dst AS o FROM d UNION SELECT dst, src FROM d), g AS (SELECT id, count(*) AS degree FROM z GROUP BY 1) SELECT e.id, coalesce(degree, 0) AS degree FROM e LEFT JOIN g USING (id)")
def degree(spark, sf):
    return S.degrees(_emb(spark, sf), S.knn_edges(_pairs(spark, sf), 10, 0.6))


@query("EVC-01", _EMB + ", g AS (SELECT cluster_id, list(s ORDER BY i) AS s, any_value(n) AS n FROM (SELECT cluster_id, i, sum(u[i]) AS s, count(*) AS n FROM u, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY 1), d AS (SELECT u.id, u.cluster_id AS own, g.cluster_id AS c, CASE WHEN u.cluster_id = g.cluster_id THEN (g.n - list_inner_product(u.u, g.s)) / (g.n - 1) ELSE 1 - list_inner_product(u.u, g.s) / g.n END AS d FROM u, g), p AS (SELECT id, min(d) FILTER (own = c) AS a, min(d) FILTER (own <> c) AS b FROM d GROUP BY 1) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM p")
def silhouette(spark, sf):
    return _r(E.cosine_silhouette(_emb(spark, sf)), "silhouette", places=6)


_DB = ", c AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(v[i]) AS m FROM e, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY 1), s AS (SELECT e.cluster_id, any_value(c) AS c, avg(list_distance(e.v, c.c)) AS s FROM e JOIN c USING (cluster_id) GROUP BY 1), r AS (SELECT a.cluster_id, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.cluster_id <> b.cluster_id GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r"


@query("EVC-02", _EMB + _DB)
def davies(spark, sf):
    return _r(E.davies_bouldin(_emb(spark, sf)), "davies_bouldin", places=6)


@query("EVC-03")
def validity(spark, sf):
    """The density index of the labelled clusters."""
    return D.validity(_emb(spark, sf).select("id", "vector", "cluster_id"))


@query("EVC-04", "SELECT 'fewer than two clusters' AS one, CAST(NULL AS VARCHAR) AS every")
def guards(spark, sf):
    e = _emb(spark, sf)
    return spark.createDataFrame([(E.check_clusters(e.withColumn("cluster_id", F.lit(1))), E.check_clusters(e))], "one string, every string")


@query("EVC-05", _EMB + _DB)
def generic(spark, sf):
    rows = V.parse_vectors(_emb(spark, sf).withColumn("vector", F.to_json("vector")), "vector")
    return _r(E.davies_bouldin(rows), "davies_bouldin", places=6)


@query("EVC-12", _EMB + ", h AS (SELECT *, id % 2 AS g FROM e), c AS (SELECT g, cluster_id, list(m ORDER BY i) AS c FROM (SELECT g, cluster_id, i, avg(v[i]) AS m FROM h, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY ALL), s AS (SELECT h.g, h.cluster_id, any_value(c) AS c, avg(list_distance(h.v, c.c)) AS s FROM h JOIN c USING (g, cluster_id) GROUP BY ALL), r AS (SELECT a.g, a.cluster_id, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.g = b.g AND a.cluster_id <> b.cluster_id GROUP BY ALL) SELECT CAST(g AS INTEGER) AS g, round(avg(r), 6) AS davies_bouldin FROM r GROUP BY 1")
def by_module(spark, sf):
    out = None
    for g in (0, 1):
        one = E.davies_bouldin(_emb(spark, sf).where(F.col("id") % 2 == g)).select(F.lit(g).alias("g"), F.round("davies_bouldin", 6).alias("davies_bouldin"))
        out = one if out is None else out.union(one)
    return out


_OV = f"WITH {TICKETS}, o AS (SELECT modul AS a, site AS b, count(*) AS n FROM t GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY a) AS p, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM o), g AS (SELECT a AS cluster_a, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, max(b) FILTER (r = 1) AS dominant, max(p) AS purity, -sum(p * log2(p)) AS entropy, CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END AS entropy_norm FROM q GROUP BY 1) "


def _purity(spark, sf):
    return E.purity(tickets(spark, sf).groupBy(F.col("modul").alias("cluster_a"), F.col("site").alias("cluster_b")).agg(F.count("*").alias("n")))


@query("EVC-06", _OV + "SELECT cluster_a, n, k, dominant, round(purity, 9) AS purity, round(entropy, 9) AS entropy, round(entropy_norm, 9) AS entropy_norm FROM g")
def purities(spark, sf):
    return _r(_purity(spark, sf), "purity", "entropy", "entropy_norm").select("cluster_a", "n", "k", "dominant", "purity", "entropy", "entropy_norm")


@query("EVC-07", _OV + "SELECT round(sum(purity * n) / sum(n), 9) AS purity, round(sum(entropy_norm * n) / sum(n), 9) AS entropy_norm FROM g")
def aligned(spark, sf):
    return _r(E.alignment(_purity(spark, sf)), "purity", "entropy_norm")


@query("EVC-08", f"WITH {TICKETS}, f AS (SELECT DISTINCT cluster_id FROM t WHERE price > 400000), o AS (SELECT DISTINCT cluster_id FROM t WHERE site = 'P'), b AS (SELECT cluster_id FROM f INTERSECT SELECT cluster_id FROM o), a AS (SELECT cluster_id FROM f UNION SELECT cluster_id FROM o) SELECT (SELECT count(*) FROM f) AS n_a, (SELECT count(*) FROM o) AS n_b, (SELECT count(*) FROM b) AS n_both, round((SELECT count(*) FROM b) / (SELECT count(*) FROM a), 9) AS jaccard, round((SELECT count(*) FROM b) / (SELECT count(*) FROM f), 9) AS rate_a, round((SELECT count(*) FROM b) / (SELECT count(*) FROM o), 9) AS rate_b")
def jaccard(spark, sf):
    t = tickets(spark, sf)
    return _r(E.set_agreement(t.where("price > 400000"), t.where("site = 'P'"), "cluster_id"), "jaccard", "rate_a", "rate_b")


@query("EVC-09", f"WITH {TICKETS}, r AS (SELECT *, row_number() OVER (PARTITION BY modul ORDER BY price DESC, incident_id) AS r FROM t) SELECT modul, incident_id AS best FROM r WHERE r = 1")
def best(spark, sf):
    from reprise.operators.relational import first_per_key

    return first_per_key(tickets(spark, sf), ["modul"], [F.desc("price"), F.col("incident_id")]).select("modul", F.col("incident_id").alias("best"))


@query("EVC-10", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def from_json(spark, sf):
    return E.recommended(load(spark, sf, "events"), "props", {"page": "$.page"}).select("event_id", "page")
