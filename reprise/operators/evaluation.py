"""How good clusters are, how two clusterings agree, and which run is best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.operators.vectors import centroids, unit


def check_clusters(rows: DataFrame, cluster: str = "cluster_id", least_points: int = 10) -> str | None:
    """Why a metric has no value, or None: too few points, fewer than two clusters, or one for each point."""
    r = rows.agg(F.count("*").alias("n"), F.countDistinct(cluster).alias("k")).first()
    if r["n"] < least_points:
        return "too few points"
    if r["k"] < 2:
        return "fewer than two clusters"
    return "every point is a cluster" if r["k"] == r["n"] else None


def cosine_silhouette(rows: DataFrame, vector: str = "vector", cluster: str = "cluster_id") -> DataFrame:
    """One row with the mean silhouette under cosine distance, linear in the rows: distances to a cluster are a dot product with its sum.

    Null where a metric has no value. A point alone in its cluster counts 0.
    """
    if check_clusters(rows, cluster, 2):
        return rows.sparkSession.range(1).select(F.lit(None).cast("double").alias("silhouette"))
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    ids = rows.select(F.dense_rank().over(W.orderBy(cluster)).alias("_"), cluster).limit(0)  # keeps the schema's type
    named = rows.select(F.col(cluster)).distinct().withColumn("prediction", (F.row_number().over(W.orderBy(cluster)) - 1).cast("double"))
    data = rows.join(F.broadcast(named), cluster).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), "prediction")
    value = ClusteringEvaluator(distanceMeasure="cosine").evaluate(data)
    return ids.sparkSession.range(1).select(F.lit(float(value)).alias("silhouette"))


def davies_bouldin(rows: DataFrame, vector: str = "vector", cluster: str = "cluster_id", key: str = "id", least: int = 1, top: int = 400) -> DataFrame:
    """One row with the Davies-Bouldin index over the `top` largest clusters of at least `least` rows; null with fewer than two."""
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).orderBy(F.desc("_n"), cluster).limit(top)
    kept = rows.join(F.broadcast(sizes), cluster)
    centers = centroids(kept, vector, cluster, key).select(cluster, "centroid")
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    spread = kept.join(F.broadcast(centers), cluster).groupBy(cluster).agg(F.avg(gap(F.col(vector), F.col("centroid"))).alias("s"), F.first("centroid").alias("c"))
    a, b = spread.select(F.col(cluster).alias("i"), F.col("s").alias("si"), F.col("c").alias("ci")), spread.select(F.col(cluster).alias("j"), F.col("s").alias("sj"), F.col("c").alias("cj"))
    worst = a.join(F.broadcast(b), F.col("i") != F.col("j")).groupBy("i").agg(F.max(F.try_divide(F.col("si") + F.col("sj"), gap(F.col("ci"), F.col("cj")))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def euclidean_silhouette(rows: DataFrame, vector: str = "vector", cluster: str = "cluster_id", key: str = "id") -> DataFrame:
    """One row with the mean silhouette under Euclidean distance, over the rows given. Quadratic: sample first, as the reports do."""
    gap = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    a = rows.select(F.col(key).alias("a"), F.col(cluster).alias("ca"), F.col(vector).alias("va"))
    b = rows.select(F.col(key).alias("b"), F.col(cluster).alias("cb"), F.col(vector).alias("vb"))
    means = a.join(b, F.col("a") != F.col("b")).groupBy("a", "ca", "cb").agg(F.avg(gap).alias("d"))
    per = means.groupBy("a").agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("d"))).alias("own"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("d"))).alias("other"))
    s = F.when(F.col("own").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return per.agg(F.avg(s).alias("silhouette"))


def purity(overlaps: DataFrame) -> DataFrame:
    """(cluster_a, n, k, dominant, purity, entropy, entropy_norm) of overlaps (cluster_a, cluster_b, n); entropy in bits, over log2 of k where k > 1."""
    w = W.partitionBy("cluster_a")
    p = F.col("n") / F.sum("n").over(w)
    rows = overlaps.withColumn("p", p)
    per = rows.groupBy("cluster_a").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max(F.struct("n", F.struct((F.lit(0) - F.hash("cluster_b")).alias("_h"), F.col("cluster_b").alias("_b")))).alias("_m"), F.max("p").alias("purity"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    best = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "cluster_b"))).where("_r = 1").select("cluster_a", F.col("cluster_b").alias("dominant"))
    return per.drop("_m").join(best, "cluster_a").withColumn("entropy", F.abs("entropy")).withColumn("entropy_norm", F.when(F.col("k") > 1, F.col("entropy") / F.log2(F.col("k").cast("double"))).otherwise(0.0))


def alignment(purities: DataFrame) -> DataFrame:
    """Means of purity and normalised entropy, weighted by cluster size, in one row."""
    n = F.sum("n")
    return purities.agg((F.sum(F.col("purity") * F.col("n")) / n).alias("purity"), (F.sum(F.col("entropy_norm") * F.col("n")) / n).alias("entropy_norm"))


def set_agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes, shared keys, Jaccard (1 for two empty sets) and the shares of either set."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    n = left.join(right, key, "full").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count("*").alias("n_any"))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return n.select("n_a", "n_b", "n_both", F.when(F.col("n_any") == 0, 1.0).otherwise(share("n_both", "n_any")).alias("jaccard"), share("n_both", "n_a").alias("rate_a"), share("n_both", "n_b").alias("rate_b"))


def recommended(rows: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """`rows` with one column for each JSON path."""
    return rows.withColumns({name: F.get_json_object(column, path) for name, path in paths.items()})


def histogram_rows(rows: DataFrame, edges: str, counts: str) -> DataFrame:
    """Arrays of bin edges and counts as rows (bin, lo, hi, n)."""
    z = F.arrays_zip(F.slice(edges, 1, F.size(counts)).alias("lo"), F.slice(edges, F.lit(2), F.size(counts)).alias("hi"), F.col(counts).alias("n"))
    return rows.select(F.posexplode(z).alias("bin", "_z")).select("bin", F.col("_z.lo").alias("lo"), F.col("_z.hi").alias("hi"), F.col("_z.n").alias("n"))


def normalized(rows: DataFrame, vector: str = "vector") -> DataFrame:
    return rows.withColumn(vector, unit(F.col(vector)))
