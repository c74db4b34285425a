"""TF-IDF sums within clusters, over buckets of documents in place of a shuffled row for each document and term."""

from __future__ import annotations

from itertools import starmap

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.plans.lineage import cut

#: Words in a share of a cluster's documents, in a bucket of shares, in a group of buckets on average, and in those whose terms meet in one task.
SHARE, BUCKET, GROUP, PART = 250_000, 500_000, 1_000_000, 4_000_000
#: Best terms that a bucket tells of each cluster, as a multiple of those wanted.
TOLD = 4
#: More clusters than this are joined by a shuffle.
MOST_BROADCAST = 100_000
_PRIME = np.uint64((1 << 31) - 1)


def press(**columns) -> bytes:
    import pyarrow as pa

    batch, sink = pa.record_batch(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpress(raw: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(raw).read_all()


class Bucket:
    """The distinct terms of a bucket's clusters, ordered alike whatever the order of its rows, and their counts by document."""

    def __init__(self, table, bigrams: bool):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        column = lambda name: pa.concat_arrays(table[name].chunks) if table[name].num_chunks else pa.array([], table.schema.field(name).type)
        names = column("cluster_id").dictionary_encode()
        self.clusters, cluster = names.dictionary, names.indices.to_numpy().astype(np.int64)
        self.n_docs, self.parts, self.whole = (np.zeros(len(self.clusters), np.int64) for _ in range(3))
        self.n_docs[cluster], self.parts[cluster], self.whole[cluster] = column("n_docs").to_numpy(), column("parts").to_numpy(), column("shares").to_numpy() == 1
        ids = column("doc_id").dictionary_encode()
        documents, row_doc = np.unique(cluster * len(ids.dictionary) + ids.indices.to_numpy(), return_inverse=True)
        sizes = column("sizes")
        lengths = sizes.value_lengths().to_numpy().astype(np.int64)
        offsets = np.r_[0, np.cumsum(sizes.flatten().to_numpy(), dtype=np.int64)].astype(np.int32)
        joined = b"".join(x.as_buffer() for x in column("words").cast(pa.binary()))
        words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(joined)).dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = words.dictionary.take(pa.array(order))
        word, row = rank[words.indices.to_numpy()], np.repeat(np.arange(len(lengths)), lengths)
        n_words = max(1, len(order))
        singles, single = np.unique(cluster[row] * n_words + word, return_inverse=True)
        self.cluster, self.first, self.second = singles // n_words, singles % n_words, np.full(len(singles), -1)
        term, doc = single, row_doc[row]
        if bigrams:
            at = np.flatnonzero(row[1:] == row[:-1])
            pairs, pair = np.unique(single[at] * n_words + word[at + 1], return_inverse=True)
            left = singles[pairs // n_words]
            self.cluster, self.first, self.second = np.r_[self.cluster, left // n_words], np.r_[self.first, left % n_words], np.r_[self.second, pairs % n_words]
            term, doc = np.r_[single, pair + len(singles)], np.r_[doc, doc[at]]
        if bigrams and pc.any(pc.match_substring(self.words, " ")).as_py():  # a word with a blank may be another two words
            texts = self.text(np.arange(len(self.first))).dictionary_encode()
            order = pc.sort_indices(texts.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            keys, same = np.unique(self.cluster * len(order) + rank[texts.indices.to_numpy()], return_inverse=True)
            self.words, self.cluster, self.first, self.second, term = texts.dictionary.take(pa.array(order)), keys // len(order), keys % len(order), np.full(len(keys), -1), same[term]
        n_terms = max(1, len(self.cluster))
        entries, self.tf = np.unique(doc * n_terms + term, return_counts=True)
        self.doc, self.term = entries // n_terms, entries % n_terms
        self.df = np.bincount(self.term, minlength=len(self.cluster))

    def text(self, at: np.ndarray):
        import pyarrow as pa
        import pyarrow.compute as pc

        first, second = self.words.take(pa.array(self.first[at])), self.words.take(pa.array(np.maximum(self.second[at], 0)))
        return pc.if_else(pa.array(self.second[at] >= 0), pc.binary_join_element_wise(first, second, " "), first)

    def part(self) -> np.ndarray:
        """The part of each term: its bytes as one number, modulo a prime; equal in every bucket."""
        digest = lambda words: np.array([int.from_bytes(w.encode(), "big") % int(_PRIME) for w in words], np.uint64)
        words = self.words.to_pylist()
        one, shift = digest(words), np.array([pow(256, len(w.encode()), int(_PRIME)) for w in words], np.uint64)
        value, two = one[self.first], self.second >= 0
        a, b = self.first[two], self.second[two]
        value[two] = ((one[a] * np.uint64(256) + np.uint64(32)) % _PRIME * shift[b] + one[b]) % _PRIME
        return (value % self.parts[self.cluster].astype(np.uint64)).astype(np.int64)

    def packs(self):
        """(cluster, part, terms) of the clusters that other buckets share."""
        part = self.part()
        at = np.flatnonzero(self.whole[self.cluster] == 0)
        at = at[np.lexsort((self.second[at], self.first[at], part[at], self.cluster[at]))]
        edges = np.flatnonzero((np.diff(self.cluster[at]) != 0) | (np.diff(part[at]) != 0)) + 1
        for own in np.split(at, edges) if len(at) else []:
            yield int(self.cluster[own[0]]), int(part[own[0]]), own

    def sums(self, df: np.ndarray, least: bool = False) -> np.ndarray:
        """The terms' sums over the bucket's documents; with `least` no more than they can be if df are no more than the frequencies."""
        w = self.tf * (np.log((1 + self.n_docs[self.cluster]) / (1 + df)) + 1)[self.term]
        norm = np.sqrt(np.bincount(self.doc, weights=w * w))
        return np.bincount(self.term, weights=(self.tf if least else w) / norm[self.doc], minlength=len(df))

    def best(self, sums: np.ndarray, n: int):
        """(cluster, terms) of the n greatest sums of each cluster, in descending order."""
        order = np.lexsort((-sums, self.cluster))
        ranked = self.cluster[order]
        for c in np.unique(ranked).tolist():
            a, b = np.searchsorted(ranked, [c, c + 1])
            yield c, order[a : min(b, a + n)]


def bundle(table, by: str):
    """(by, packed): the rows of a table with tokens, those of each value of `by` as one pressed table with words and sizes."""
    import pyarrow as pa

    table = table.combine_chunks().sort_by(by) if table.num_rows else table
    keys, columns = table[by].to_numpy(), {c: table[c] for c in table.column_names if c not in (by, "tokens")}
    columns = {c: x.combine_chunks() for c, x in columns.items()}
    columns = {c: pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
    tokens = table["tokens"].combine_chunks()
    tokens = pa.concat_arrays(tokens.chunks) if isinstance(tokens, pa.ChunkedArray) else tokens
    at, (_, offsets, data) = tokens.offsets.to_numpy(), tokens.values.cast(pa.string()).buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(tokens.values) + 1] if len(tokens.values) else np.zeros(1, np.int32)
    sizes = np.diff(ends)
    columns["sizes"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sizes, pa.uint8() if not len(sizes) or sizes.max() < 256 else pa.int32()))
    columns["words"] = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(ends[at].tobytes()), data)
    edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else [0]
    packed = [press(**{c: x.slice(a, b - a) for c, x in columns.items()}) for a, b in zip(edges, edges[1:])]
    return pa.record_batch({by: pa.array(keys[edges[:-1]], pa.int32()), "packed": pa.array(packed, pa.binary())})


def buckets_of(table, bigrams: bool):
    """(number, Bucket) of the bundles of a group: shares of one cluster after another, as many as fit; alike in whatever order they come."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = [unpress(x.as_py()) for x in table["packed"]]
    if not rows:
        return
    rows = pa.concat_tables(x.set_column(x.schema.get_field_index("sizes"), "sizes", x["sizes"].cast(pa.list_(pa.int32()))) for x in rows).combine_chunks()
    rows = rows.append_column("size", pc.list_value_length(rows["sizes"])).sort_by([("cluster_id", "ascending"), ("share", "ascending")])
    shares = rows.group_by(["cluster_id", "share"], use_threads=False).aggregate([("size", "sum"), ("size", "count")])
    start = stop = size = number = 0
    for words, n in zip(shares["size_sum"].to_pylist(), shares["size_count"].to_pylist()):
        if stop > start and size + words > BUCKET * 1.2:
            yield number, Bucket(rows.slice(start, stop - start), bigrams)
            pa.default_memory_pool().release_unused()
            start, size, number = stop, 0, number + 1
        stop, size = stop + n, size + words
    yield number, Bucket(rows.slice(start, stop - start), bigrams)


def topic_scores(tokens: DataFrame, top: int, min_docs: int, bigrams: bool) -> DataFrame:
    """(cluster_id, term, score) of at least the `top` best terms of each cluster, as cluster_topics defines the scores.

    Documents meet in groups of about GROUP words, pressed on the way there, and in buckets within a group. A bucket sends each of its
    distinct terms once, with its number of documents, to the task that adds these up over the buckets, and gets the sums back. It also
    tells sums that its best terms reach at least, whatever the frequencies elsewhere. No score exceeds the term's document
    frequency, so terms of a lesser frequency than the `top`-th of the sums told of a cluster are no candidates.
    """
    import pyarrow as pa

    docs = cut(tokens.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("n_docs"), F.sum(F.greatest(F.size("tokens"), F.lit(0))).alias("_size")).where(F.col("n_docs") >= min_docs))
    total = docs.agg(F.count("*").alias("n"), F.sum("_size").alias("s")).first()
    groups = max(1, -(-(total["s"] or 0) // GROUP))
    docs = docs.select("cluster_id", "n_docs", F.greatest(F.lit(1), F.ceil(F.col("_size") / SHARE)).cast("long").alias("shares"), F.greatest(F.lit(1), F.ceil(F.col("_size") / PART)).cast("long").alias("parts"))
    rows = tokens.where("doc_id IS NOT NULL AND size(tokens) > 0").join(F.broadcast(docs) if total["n"] <= MOST_BROADCAST else docs, "cluster_id")
    rows = rows.select("cluster_id", "doc_id", "n_docs", "shares", "parts", F.pmod(F.xxhash64("doc_id"), F.col("shares")).alias("share"), F.filter("tokens", lambda w: w.isNotNull()).alias("tokens"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("cluster_id", F.floor(F.col("share") / max(1, BUCKET // SHARE))), F.lit(groups)).cast("int"))

    def deal(batches):
        for batch in batches:
            yield bundle(pa.Table.from_batches([batch]), "group")

    rows = rows.mapInArrow(deal, "group int, packed binary").repartition(groups, "group")
    kind = tokens.schema["cluster_id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        group = table["group"][0].as_py()

        def one(number, b):
            found = [(c, p, press(term=b.text(own), n=pa.array(b.df[own], pa.float64()))) for c, p, own in b.packs()]
            least = b.sums(b.df, least=True)
            found += [(c, -1, press(term=b.text(own), n=pa.array(least[own]))) for c, own in b.best(least, TOLD * top) if not b.whole[c]]
            return pa.table({"group": pa.array([group] * len(found), pa.int32()), "bucket": pa.array([number] * len(found), pa.int32()), "cluster_id": b.clusters.take(pa.array([c for c, _, _ in found], pa.int64())), "part": pa.array([p for _, p, _ in found], pa.int64()), "terms": pa.array([t for _, _, t in found], pa.binary())})

        return pa.concat_tables([*starmap(one, buckets_of(table, bigrams))])

    def add(table: pa.Table) -> pa.Table:
        got = [unpress(t.as_py()) for t in table["terms"]]
        every = pa.concat_tables(got).combine_chunks()
        code = pa.concat_arrays(every["term"].chunks).dictionary_encode().indices.to_numpy()
        n = np.bincount(code, weights=every["n"].to_numpy())
        if table["part"][0].as_py() < 0:
            least = np.sort(n)[-top] if len(n) >= top else 0.0
            sums = [press(least=pa.array([least]))] * len(got)
        else:
            ends = np.cumsum([g.num_rows for g in got])
            sums = [press(df=pa.array(x)) for x in np.split(n[code].astype(np.int32), ends[:-1])]
        return table.select(["group", "bucket", "cluster_id", "part"]).append_column("df", pa.array(sums, pa.binary()))

    def score(table: pa.Table, sums: pa.Table) -> pa.Table:
        back = {(n, c, p): d for n, c, p, d in zip(*(sums[x].to_pylist() for x in ("bucket", "cluster_id", "part")), sums["df"])}
        none = pa.table({"cluster_id": pa.array([], sums["cluster_id"].type), "term": pa.array([], pa.string()), "score": pa.array([], pa.float64())})

        def one(number, b):
            df, names, least = b.df.astype(np.int64), b.clusters.to_pylist(), np.zeros(len(b.clusters))
            for c, p, own in b.packs():
                df[own] = unpress(back[number, names[c], p].as_py())["df"].to_numpy()
            found = b.sums(df)
            for c, own in b.best(found, top):
                told = 0.0 if b.whole[c] else unpress(back[number, names[c], -1].as_py())["least"][0].as_py()
                least[c] = max(told, found[own[-1]] if len(own) == top else 0.0)
            kept = np.flatnonzero(df >= least[b.cluster] * (1 - 1e-9) - 1e-6)
            return pa.table({"cluster_id": b.clusters.take(pa.array(b.cluster[kept])), "term": b.text(kept), "score": pa.array(found[kept])})

        return pa.concat_tables([none, *starmap(one, buckets_of(table, bigrams))])

    packs = rows.groupBy("group").applyInArrow(pack, f"group int, bucket int, cluster_id {kind}, part long, terms binary")
    sums = packs.groupBy("cluster_id", "part").applyInArrow(add, f"group int, bucket int, cluster_id {kind}, part long, df binary")
    partial = rows.groupBy("group").cogroup(sums.groupBy("group")).applyInArrow(score, f"cluster_id {kind}, term string, score double")
    return partial.groupBy("cluster_id", "term").agg(F.sum("score").alias("score"))
