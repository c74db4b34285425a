"""Similarity joins, graphs of neighbours and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.operators.topics import press, unpress
from reprise.operators.vectors import dot, unit
from reprise.plans.components import connected_components
from reprise.plans.lineage import cut


#: Entries of a block of sparse vectors; a term in this share of the pairs of two blocks goes into their matrix product.
BLOCK_ENTRIES, DENSE = 400_000, 1 / 200


def sparse_pairs(weights: DataFrame, threshold: float, block: list[str] | None = None, forest: bool = False) -> DataFrame:
    """(a, b, sim), a < b, of all pairs of documents whose cosine reaches `threshold` > 0, from triplets (doc_id, term, weight).

    Exact: documents are packed into blocks, of which one copy is kept, and every two blocks meet in one task. There the terms that
    are frequent in both are a matrix product and the others are added from their postings, so no candidate pair is moved and no term
    is dropped. With `block`, only documents of equal values there are compared. With `forest`, of the pairs of two blocks only as
    many come back as link the same documents directly or through others.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    by = block or []
    known = weights.where(" AND ".join(["weight > 0", *[f"`{c}` IS NOT NULL" for c in by]]))
    most = known.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK_ENTRIES))
    kinds = "".join(f"`{c}` {weights.schema[c].dataType.simpleString()}, " for c in by)

    def pack(table: pa.Table) -> pa.Table:
        ids, terms = (table[c].combine_chunks().dictionary_encode() for c in ("doc_id", "term"))
        ids, terms = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, terms))
        doc, w = ids.indices.to_numpy(), table["weight"].to_numpy()
        w = w / np.sqrt(np.bincount(doc, weights=w * w))[doc]
        packed = {"ids": press(x=ids.dictionary), "terms": press(x=terms.dictionary), "entries": press(doc=ids.indices, term=terms.indices, w=pa.array(w))}
        return pa.table({c: table[c].slice(0, 1) for c in [*by, "_b"]} | {c: pa.array([v], pa.binary()) for c, v in packed.items()})

    def product(x, y, n: int, m: int, n_terms: int) -> np.ndarray:
        (dx, tx, wx), (dy, ty, wy) = x, y
        cx, cy = np.bincount(tx, minlength=n_terms), np.bincount(ty, minlength=n_terms)
        dense = cx * cy > n * m * DENSE
        place = np.cumsum(dense) - 1
        left, right = np.zeros((n, int(dense.sum()))), np.zeros((m, int(dense.sum())))
        left[dx[dense[tx]], place[tx[dense[tx]]]] = wx[dense[tx]]
        right[dy[dense[ty]], place[ty[dense[ty]]]] = wy[dense[ty]]
        s = (left @ right.T).ravel()
        kept = ~dense[tx] & (cy[tx] > 0)
        dx, tx, wx = dx[kept].astype(np.int64), tx[kept], wx[kept]
        order = np.argsort(ty, kind="stable")
        dy, wy, start = dy[order], wy[order], np.r_[0, np.cumsum(cy)]
        upto = np.cumsum(cy[tx])
        cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, 4_000_000), side="left")
        for lo, hi in zip(cuts, [*cuts[1:], len(tx)]):
            reach = cy[tx[lo:hi]]
            i = np.repeat(np.arange(lo, hi), reach)
            j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach) + start[tx[i]]
            s += np.bincount(dx[i] * m + dy[j], weights=wx[i] * wy[j], minlength=n * m)
        return s.reshape(n, m)

    def tree(r: np.ndarray, c: np.ndarray, n: int, same: bool) -> list[int]:
        up, kept = {}, []

        def find(v):
            while (u := up.get(v, v)) != v:
                up[v] = v = up.get(u, u)
            return v

        for e, (x, y) in enumerate(zip(r.tolist(), c.tolist())):
            x, y = find(x), find(y if same else y + n)
            if x != y:
                up[y] = x
                kept.append(e)
        return kept

    def meet(batches):
        last, one = None, None
        read = lambda raw: [c.combine_chunks() for c in unpress(raw).columns]
        plain = lambda a: pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
        for batch in batches:
            for row in range(batch.num_rows):
                ids, terms, entries, ids_2, terms_2, entries_2, same = (batch.column(i)[row].as_py() for i in range(7))
                if ids != last:
                    last, one = ids, (plain(read(ids)[0]), plain(read(terms)[0]), [plain(x).to_numpy() for x in read(entries)])
                two = one if same else (plain(read(ids_2)[0]), plain(read(terms_2)[0]), [plain(x).to_numpy() for x in read(entries_2)])
                (a, t, x), (b, u, y) = one, two
                code = pc.fill_null(pc.index_in(u, t), -1).to_numpy()
                known = code[y[1]] >= 0
                s = product(x, (y[0][known], code[y[1][known]], y[2][known]), len(a), len(b), len(t))
                r, c = np.nonzero(s >= threshold - 1e-9)
                if same:
                    r, c = r[r < c], c[r < c]
                if forest:
                    kept = tree(r, c, len(a), same)
                    r, c = r[kept], c[kept]
                left, right = a.take(pa.array(r)), b.take(pa.array(c))
                less = pc.less(left, right)
                yield pa.record_batch([pc.if_else(less, left, right), pc.if_else(less, right, left), pa.array(s[r, c])], names=["a", "b", "sim"])

    kind = weights.schema["doc_id"].dataType.simpleString()
    rows = known.select(*by, F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("_b"), "doc_id", "term", F.col("weight").cast("double").alias("weight"))
    packed = cut(rows.groupBy(*by, "_b").applyInArrow(pack, f"{kinds}_b int, ids binary, terms binary, entries binary"))
    left, right = packed.select(*[F.col(c).alias(f"p_{c}") for c in packed.columns]), packed.select(*[F.col(c).alias(f"q_{c}") for c in packed.columns])
    both = F.col("p__b") <= F.col("q__b")
    for c in by:
        both &= F.col(f"p_{c}") == F.col(f"q_{c}")
    met = left.hint("shuffle_replicate_nl").join(right, both)
    pairs = met.select("p_ids", "p_terms", "p_entries", "q_ids", "q_terms", "q_entries", (F.col("p__b") == F.col("q__b")).alias("same"))
    return pairs.mapInArrow(meet, f"a {kind}, b {kind}, sim double")


def dense_pairs(rows: DataFrame, threshold: float, block_rows: int = 2048) -> DataFrame:
    """(a, b, sim), a < b, of all pairs of (id, vector) whose cosine reaches `threshold`.

    Exact. Rows are packed into blocks; every two blocks meet in one task as a matrix product, so what is moved is
    rows * blocks, not pairs, and only pairs that pass leave the task. The work is quadratic, as the question is.
    """
    import pyarrow as pa

    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    packed = rows.select("id", unit(F.col("vector")).alias("u"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("i"))
    meets = packed.select("id", "u", "i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    meets = meets.select("id", "u", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i")
    meets = meets.distinct() if blocks == 1 else meets

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        ids = table["id"].to_numpy()
        x = np.array(table["u"].to_pylist(), dtype=float)
        side = table["i"].to_numpy()
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        left, right = np.flatnonzero(side == p), np.flatnonzero(side == q)
        s = x[left] @ x[right].T
        r, c = np.nonzero(s >= threshold - 1e-9)
        a, b, v = ids[left][r], ids[right][c], s[r, c]
        if p == q:
            keep = a < b
            a, b, v = a[keep], b[keep], v[keep]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": np.minimum(v, 1.0)})

    return meets.groupBy("p", "q").applyInArrow(run, "a long, b long, sim double")


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, sim, rank): the k most similar of each end of the pairs, ties by neighbour. Self is no neighbour."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "sim").union(pairs.select(F.col("b").alias("id"), F.col("a").alias("neighbour"), "sim"))
    order = W.partitionBy("id").orderBy(F.round("sim", 12).desc(), "neighbour")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_edges(pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """Edges from each row to those of its k nearest neighbours that reach the threshold."""
    return top_k(pairs, k).where(F.col("sim") >= threshold - 1e-9).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), "sim")


def within_days(edges: DataFrame, times: DataFrame, days: int) -> DataFrame:
    """Edges whose ends (id, ts) lie at most `days` dates apart; applied after the neighbours are chosen."""
    a, b = times.select(F.col("id").alias("src"), F.col("ts").alias("_ta")), times.select(F.col("id").alias("dst"), F.col("ts").alias("_tb"))
    return edges.join(a, "src").join(b, "dst").where(F.abs(F.datediff("_ta", "_tb")) <= days).drop("_ta", "_tb")


def cluster_by_graph(ids: DataFrame, edges: DataFrame, min_size: int = 1, noise: int = -1) -> DataFrame:
    """(id, cluster_id): connected components, each called by its least id; smaller ones than min_size are noise."""
    parts = connected_components(edges)
    rows = ids.select("id").distinct().join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("cluster_id"))
    if min_size <= 1:
        return rows
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    return rows.join(sizes, "cluster_id").select("id", F.when(F.col("_n") >= min_size, F.col("cluster_id")).otherwise(noise).alias("cluster_id"))


def ranked_by_size(members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`members` with label: clusters numbered from 0 by size, largest first, ties by id, within `keys`."""
    keys = keys or []
    sizes = members.groupBy(*keys, "cluster_id").agg(F.count("*").alias("_n"))
    numbered = sizes.withColumn("label", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), "cluster_id")) - 1).drop("_n")
    return members.join(numbered, [*keys, "cluster_id"])


def adaptive_k(n: int, base: int, most: int = 200) -> int:
    """Neighbours for n rows: the larger of base and five square roots of n, at most `most` and n - 1."""
    return max(1, min(n - 1, most, max(base, int(5 * n**0.5))))


def degrees(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every id: its distinct neighbours."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("o")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("o"))).where("id <> o").distinct()
    return ids.select("id").join(both.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def search(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, sim): the k rows most similar to one vector, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("id", dot(unit(F.col("vector")), unit(q)).alias("sim")).orderBy(F.round("sim", 12).desc(), "id").limit(k)


def threshold_coverage(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_pairs, mean_sim, n_anchors): of anchor pairs (a, b, sim), those at each threshold or above."""
    each = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(F.col("sim") >= F.col("threshold") - 1e-9)
    found = each.groupBy("threshold").agg(F.count("*").alias("n_pairs"), F.avg("sim").alias("mean_sim"), F.countDistinct("a").alias("n_anchors"))
    every = pairs.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return every.join(found, "threshold", "left").select("threshold", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "mean_sim", F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"))


def kmeans(rows: DataFrame, k: int, seed: int = 42, vector: str = "vector") -> DataFrame:
    """`rows` with cluster_id by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(v)
    return model.transform(v).drop("features")
