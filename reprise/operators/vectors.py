"""TF-IDF vectors, vector algebra, centroids and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.plans.lineage import cut


#: A vocabulary of more terms than this is joined by a shuffle.
MOST_BROADCAST = 500_000


def term_frequencies(docs: DataFrame, tokens: str = "tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns to keep, term, tf, n_tokens) of (doc_id, tokens), one row for each document; n_tokens counts all tokens, also
    those that a vocabulary drops later. Terms are counted within the row, without a shuffle."""
    import pyarrow as pa

    rest = ["doc_id", *keep]

    def count(batches):
        import numpy as np

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                lists = rows.column("_t")
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                terms = lists.flatten().dictionary_encode(null_encoding="encode")
                n = max(1, len(terms.dictionary))
                found, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + terms.indices.to_numpy(), return_counts=True)
                at = pa.array(found // n)
                out = [rows.column(c).take(at) for c in rest] + [terms.dictionary.take(pa.array(found % n)), pa.array(tf, pa.int64()), pa.array(sizes[found // n], pa.int32())]
                yield pa.record_batch(out, names=[*rest, "term", "tf", "n_tokens"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, F.col(tokens).alias("_t")).mapInArrow(count, f"{kinds}, term string, tf long, n_tokens int")


def vocabulary(tf: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, idf): idf is ln((1 + n) / (1 + df)) + 1; kept are terms of min_df documents or more and at most max_df of them.

    max_features keeps the terms of the largest total counts, ties by term.
    """
    v = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_total"))
    v = v.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        v = v.orderBy(F.desc("_total"), "term").limit(max_features)
    return v.select("term", "df", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(docs: DataFrame, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, norm: str | None = None, sublinear: bool = False, tokens: str = "tokens", relative: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns to keep, term, tf, idf, weight) in triplets.

    tf is the count over all of the document's tokens, or with relative off the count, or 1 + ln of it where sublinear. norm l1 or l2 scales each
    document's weights. Documents without a known term have no rows.
    """
    counts = term_frequencies(docs, tokens, keep)
    terms = cut(vocabulary(counts, docs.count(), min_df, max_df, max_features))
    known = counts.join(F.broadcast(terms) if terms.count() <= MOST_BROADCAST else terms, "term")
    tf = F.col("tf").cast("double")
    value = 1 + F.log(tf) if sublinear else tf / F.col("n_tokens") if relative else tf
    rows = known.select("doc_id", *keep, "term", value.alias("tf"), "idf", (value * F.col("idf")).alias("weight"))
    if norm:
        over = W.partitionBy("doc_id")
        size = F.sum(F.abs("weight")).over(over) if norm == "l1" else F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(over))
        rows = rows.withColumn("weight", F.try_divide("weight", size))
    return rows


def as_maps(weights: DataFrame, top: int | None = None) -> DataFrame:
    """(doc_id, vector): triplets as a map from term to weight, of the `top` largest where given (ties by term)."""
    if top is not None:
        weights = weights.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))).where(F.col("_r") <= top)
    return weights.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "weight")))).alias("vector"))


def unit(v: Column) -> Column:
    """A vector over its Euclidean length; a zero vector as it is."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def parse_vectors(rows: DataFrame, column: str, dim: int | None = None) -> DataFrame:
    """`rows` with the JSON arrays of a column as array<double>; unreadable ones, and those of another dimension than dim (or the most usual), go."""
    rows = rows.withColumn(column, F.from_json(column, "array<double>")).where(F.col(column).isNotNull() & (F.size(column) > 0))
    if dim is None:
        usual = rows.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        dim = usual["d"] if usual else 0
    return rows.where((F.size(column) == dim) & ~F.exists(column, lambda x: x.isNull()))


def centroids(members: DataFrame, vector: str = "vector", cluster: str = "cluster_id", key: str = "id") -> DataFrame:
    """(cluster, centroid, n, representative): the mean vector, and the least key of each cluster."""
    each = members.select(cluster, key, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gathered = means.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    counts = members.groupBy(cluster).agg(F.count("*").alias("n"), F.min(key).alias("representative"))
    return gathered.join(counts, cluster)


def nearest_centroids(queries: DataFrame, centers: DataFrame, k: int = 5, vector: str = "vector", most: int = 20_000) -> DataFrame:
    """(id, topk_rank, cluster_id, cosine_sim): the k nearest centroids of each query vector, ties by cluster.

    The centroids travel as one array to every task, which is checked: more than `most` are an error. No rows are paired in a shuffle.
    """
    n = centers.count()
    if n > most:
        raise ValueError(f"{n} centroids; at most {most} are broadcast")
    table = centers.agg(F.collect_list(F.struct("cluster_id", unit(F.col("centroid")).alias("c"))).alias("_table"))
    scored = queries.withColumn("_u", unit(F.col(vector))).crossJoin(F.broadcast(table))
    best = F.slice(F.reverse(F.array_sort(F.transform("_table", lambda t: F.struct(F.round(dot(F.col("_u"), t["c"]), 12).alias("s"), (-t["cluster_id"]).alias("k"))))), 1, k)
    return scored.select("id", F.posexplode(best).alias("_p", "_b")).select("id", (F.col("_p") + 1).alias("topk_rank"), (-F.col("_b.k")).alias("cluster_id"), F.col("_b.s").alias("cosine_sim"))


def module_features(tokens: DataFrame) -> DataFrame:
    """(modul, term, n_docs, df, df_ratio, idf) of (doc_id, modul, tokens), counted within each module."""
    n = tokens.groupBy("modul").agg(F.count("*").alias("n_docs"))
    df = tokens.select("modul", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("modul", "term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), "modul").select("modul", "term", "n_docs", "df", (F.col("df") / F.col("n_docs")).alias("df_ratio"), (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def embed(docs: DataFrame, model, dim: int, batch: int = 256) -> DataFrame:
    """(doc_id, embedding): unit vectors of (doc_id, text) by `model`, a function from a list of texts to a list of vectors.

    The model is called batch by batch on the executors; it is sent as it is, so one that loads lazily loads once for each worker.
    """
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            parts = [np.asarray(model(texts[i : i + batch]), dtype="float32") for i in range(0, len(texts), batch)]
            x = np.concatenate(parts) if parts else np.zeros((0, dim), "float32")
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=x.copy(), where=size > 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "embedding"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, embedding array<float>")


def hashed_model(dim: int = 64):
    """A stand-in model: signed feature hashing of words. Needs no files."""
    def encode(texts):
        import zlib

        import numpy as np

        out = np.zeros((len(texts), dim), "float32")
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x10000 else -1
        return out

    return encode


def principal_components(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """`rows` with pca: the first k principal components of array vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")


def truncated_svd(rows: DataFrame, vector: str, k: int, key: str = "id") -> DataFrame:
    """(key, svd): rows times the k leading right singular vectors, scaled to unit population deviation and zero mean by column."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    m = RowMatrix(rows.select(vector).rdd.map(lambda r: Vectors.dense([float(x) for x in r[0]])))
    basis = m.computeSVD(k).V.toArray()
    columns = [F.array(*[F.lit(float(x)) for x in basis[:, j]]) for j in range(basis.shape[1])]
    projected = rows.select(key, F.array(*[dot(F.col(vector).cast("array<double>"), c) for c in columns]).alias("p"))
    stats = projected.agg(*[f(F.col("p")[j]).alias(f"{n}{j}") for j in range(basis.shape[1]) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [(F.col("p")[j] - stats[f"m{j}"]) / (stats[f"s{j}"] or 1.0) for j in range(basis.shape[1])]
    return projected.select(key, F.array(*scaled).alias("svd"))
