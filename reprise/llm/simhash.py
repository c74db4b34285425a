"""SimHash near-duplicates by one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import row_keys
from reprise.llm.positional import small
from reprise.plans.components import connected_components
from reprise.plans.lineage import cut

#: Links reach this many differing bits: two segments of 32 bits, of which one differs by at most one bit.
MAX_BITS = 3
#: Segments of 32 bits that candidates for near copies are looked up by, one wildcard each; even.
SEGMENTS = 6
#: After the first turn, so many more of them; the last one takes all candidates.
TURNS = 2
#: Candidates for near copies differ in at most so many of 64 further bits; texts that have nothing in common differ in about 32.
SKETCH_BITS = 16
#: Buckets of more fingerprints than this are not compared within; they are cut further.
BUCKET = 2048

_POPCOUNT = np.array([bin(i).count("1") for i in range(65536)], dtype=np.uint8)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    parts = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    hashes = np.frombuffer(b"".join([digest(b" ".join(p), seed) for p in parts]), dtype=np.uint8)
    bits = np.unpackbits(hashes).reshape(-1, 64)
    majority = bits.sum(0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(majority).tobytes(), "big", signed=True)


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """The distinct hashes of the shingles of `size` words, ascending; of fewer words, that of all of them."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    parts = zip(*[words[i:] for i in range(size)]) if len(words) >= size else [words]
    return np.unique(np.frombuffer(b"".join([digest(b" ".join(p), 42) for p in parts]), dtype=">u8").astype(np.uint64))


def word_fingerprints(words: list[bytes], shingle: int, draws: int) -> list[int]:
    """`draws` SimHashes of the distinct shingles of one text's words, each over remixed hashes; zeros without words."""
    h = _hashes(words, shingle)
    out = []
    for _ in range(draws):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)
        majority = bits.sum(0, dtype=np.int64) * 2 > len(bits)
        out.append(int.from_bytes(np.packbits(majority).tobytes(), "big", signed=True))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(30)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of `docs` (doc_id, text); a null text has no words and fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    m = np.uint64(0xFFFF)
    return _POPCOUNT[x & m] + _POPCOUNT[(x >> np.uint64(16)) & m] + _POPCOUNT[(x >> np.uint64(32)) & m] + _POPCOUNT[x >> np.uint64(48)]


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked in one bucket: one for each member that a search from a linked one reaches first."""
    left, src, dst = np.ones(len(fps), bool), [], []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            at = stack.pop()
            near = np.flatnonzero(left & (_differing(fps, fps[at]) <= MAX_BITS))
            left[near] = False
            stack += near.tolist()
            src += [at] * len(near)
            dst += near.tolist()
    return fps[src], fps[dst]


def _parts(free: int) -> list[int]:
    """Four masks that share out the free bits."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << b for b in bits[j::4]) for j in range(4)]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside buckets of rows (key, fp, free) that come sorted by key; (src, dst, key, free), key null for a link.

    Of each bucket only a spanning forest of its links leaves, but for buckets of up to eight, whose few links
    leave as they are. A bucket of more than BUCKET is sent on, cut four ways by the bits that its
    members may still differ in: with at most three bits differing, one part is equal.
    """
    names = ["src", "dst", "key", "free"]

    def out(a, b, keys=None, free=None):
        n = len(a)
        signed = lambda x: pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([signed(a), signed(b), signed(keys) if keys is not None else pa.nulls(n, pa.int64()), signed(free) if free is not None else pa.nulls(n, pa.int64())], names)

    def onward(key, fps, free):
        parts = _parts(int(free))
        for mask in parts:
            held = fps & np.uint64(mask)
            keys = np.array([xxhash.xxh64_intdigest(key.tobytes() + h.tobytes() + mask.to_bytes(8, "little")) for h in held], dtype=np.uint64)
            yield out(fps, fps, keys, np.full(len(fps), free & np.uint64(~mask & 0xFFFFFFFFFFFFFFFF), dtype=np.uint64))

    key = np.zeros(0, np.uint64)
    fps, free, large = key, key, None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [np.asarray(c).view(np.uint64) for c in batch.columns]
        key, fps, free = (np.concatenate(pair) for pair in zip((key, fps, free), own))
        last = np.flatnonzero(key != key[-1])
        stop = last[-1] + 1 if len(last) else 0
        for done in _close(key[:stop], fps[:stop], free[:stop], large, out, onward):
            yield done
        if stop:
            large = None
        key, fps, free = key[stop:], fps[stop:], free[stop:]
        if large == key[0] or len(key) > BUCKET:
            large = key[0]
            yield from onward(key[0], fps, free[0])
            key, fps, free = key[:0], fps[:0], free[:0]
    yield from _close(key, fps, free, large, out, onward)


def _close(key, fps, free, large, out, onward):
    """Links of whole buckets; a bucket whose first rows were sent on already goes the same way."""
    if not len(key):
        return
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[first, len(key)])
    if large is not None and key[0] == large:
        yield from onward(key[0], fps[: sizes[0]], free[0])
        first, sizes = first[1:], sizes[1:]
    src, dst = [], []
    small = np.repeat(sizes, sizes) if len(sizes) else np.zeros(0, np.int64)
    base = first[0] if len(first) else len(key)
    at = np.arange(base, len(key))
    end = np.repeat(first + sizes, sizes)
    for lag in range(1, 8):
        i = at[(small <= 8) & (at + lag < end)]
        if not len(i):
            break
        near = i[_differing(fps[i], fps[i + lag]) <= MAX_BITS]
        src.append(fps[near])
        dst.append(fps[near + lag])
    for f, n in zip(first[sizes > 8], sizes[sizes > 8]):
        if n > BUCKET:
            yield from onward(key[f], fps[f : f + n], free[f])
            continue
        a, b = _forest(fps[f : f + n])
        src.append(a)
        dst.append(b)
    if src and sum(map(len, src)):
        yield out(np.concatenate(src), np.concatenate(dst))


def link_fingerprints(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(src, dst): links between distinct fingerprints at up to three differing bits, enough of them to join all that is linked.

    Each fingerprint has 66 signatures: for either 32-bit segment the segment itself, and the segment with one
    bit left out, for every bit. Fingerprints at three bits or fewer share one, so an equality shuffle brings
    them together; every pair is verified on all 64 bits. A bucket never leaves as all its pairs, and one of more
    than BUCKET members is cut by further bits until it is smaller, which ends as the free bits run out.
    """
    low = F.lit(0xFFFFFFFF)
    k, f = F.col("k"), F.col("fp")
    segment = F.when(k < 33, f.bitwiseAND(low)).otherwise(F.shiftrightunsigned(f, 32))
    bit = F.expr("shiftleft(1L, CAST(k % 33 AS INT))")
    held = F.when(k % 33 < 32, segment.bitwiseAND(F.bitwise_not(bit))).otherwise(segment)
    key = F.expr("shiftleft(CAST(k AS BIGINT), 32)").bitwiseOR(held)
    other = F.when(k < 33, F.lit(-1 << 32)).otherwise(low)
    free = F.when(k % 33 < 32, other.bitwiseOR(F.when(k < 33, bit).otherwise(F.expr("shiftleft(1L, CAST(k % 33 AS INT) + 32)")))).otherwise(other)
    rows = fps.select(F.col(fp).alias("fp")).distinct().select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k"))
    rows = rows.select(key.alias("key"), "fp", free.alias("free"))
    found = None
    while True:
        dealt = rows.repartition("key").sortWithinPartitions("key", "fp")
        step = cut(dealt.mapInArrow(_link, "src long, dst long, key long, free long"))
        links = step.where("key IS NULL").select("src", "dst")
        found = links if found is None else found.union(links)
        rows = step.where("key IS NOT NULL").select("key", F.col("src").alias("fp"), "free").distinct()
        if rows.isEmpty():
            return found


def simhash_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text).

    fingerprint is the SimHash of the word shingles in 16 hex digits; component_id is the least doc_id that links of at
    most three bits reach. Null and empty texts have fingerprint zero and are linked like any other; rows
    with a null id take part and get their group's least id (null if it has none). Copies share a
    fingerprint and are compared once. Only `doc_id` and `text` are read.
    """
    signed = cut(fingerprints(docs, shingle))
    distinct = signed.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    parts = connected_components(link_fingerprints(distinct))
    placed = distinct.join(parts, distinct.fp == parts.id, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return signed.join(known, "fp").select("doc_id", hexed, "component_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _node(words: list[bytes]) -> int:
    """What stands for all texts of the same words."""
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), 42), "big", signed=True)


def _parities(size: int):
    """(node, n, p0 to p3) of rows (node, text): the size of the text's shingle set, and the parity of how many shingles fall to each of 256 places.

    Places whose parities differ hold a shingle that one of two sets lacks, so their number bounds the sets' Jaccard from above.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_hashes(_words(t.as_py()), size) for t in batch.column(1)]
            odd = [np.packbits(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256) & 1).view(np.int64) for h in sets]
            odd = np.stack(odd) if odd else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets], pa.int64()), *[pa.array(np.ascontiguousarray(odd[:, i])) for i in range(4)]], ["node", "n", "p0", "p1", "p2", "p3"])

    return run


def _bucket_mates(similar: int, each: bool, similarity: float):
    """Pairs (src, dst) inside buckets of rows (key, node, sketch, component, and n, p0 to p3 of `_parities` or none of them) that come sorted by key.

    A pair is one whose sketches differ in at most `similar` bits, whose components differ and whose parities allow the similarity. The last bit of
    a sketch is the one that the key leaves out: of two whose segments are equal, and which so meet in all 32 buckets of the segment, that of
    its first bit alone takes the pair. With `each`, all of them leave; else, for every
    row that has such a mate, one pair with the first of them, so that a bucket of any size leaves at most one pair for each row.
    """
    def pairs(i, j, node):
        a, b = node[i], node[j]
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["src", "dst"])

    def near(i, j, key, sketch, comp, n=None, *odd):
        keep = (comp[i] != comp[j]) & ((((sketch[i] ^ sketch[j]) & np.uint64(1)) > 0) | ((key[i] >> 32) % 32 == 0))
        i, j = i[keep], j[keep]
        keep = _differing(sketch[i] >> np.uint64(1), sketch[j] >> np.uint64(1)) <= similar
        i, j = i[keep], j[keep]
        if n is not None:
            apart = sum(_differing(p[i], p[j]).astype(np.int64) for p in odd)
            keep = apart <= (n[i] + n[j]) * (1 - similarity) / (1 + similarity) + 1e-6
            i, j = i[keep], j[keep]
        return i, j

    def whole(rows):
        key, node, *facts = rows
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(key)])
        begin, end, size, at = np.repeat(first, sizes), np.repeat(first + sizes, sizes), np.repeat(sizes, sizes), np.arange(len(key))
        met = np.zeros(len(key), bool)
        left = at[(size >= 2) & (size <= 64)]
        for p in range(64):  # the row at place p of each bucket with those behind it
            left = left[begin[left] + p < end[left] - 1]
            j = left[left > begin[left] + p]
            if not len(j):
                break
            i, j = near(begin[j] + p, j, key, *facts)
            if not each:
                new = ~met[i] | ~met[j]
                i, j = i[new], j[new]
                met[i] = met[j] = True
            yield pairs(i, j, node)
        for f, m in zip(first[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
            own = np.arange(f, f + m)
            for i in own.tolist():
                if not each and met[i]:
                    continue
                _, j = near(np.full(m, i), own, key, *facts)
                if not each and len(j):
                    j = j if i == f else j[:1]
                    met[i] = met[j] = True
                if len(j):
                    yield pairs(np.full(len(j), i), j, node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, sketch, comp, *facts = [np.asarray(c) for c in batch.columns]
            held.append([key, node, sketch.view(np.uint64), comp, *facts[:1], *[p.view(np.uint64) for p in facts[1:]]])
            if key[0] == key[-1] and held[0][0][0] == key[0]:
                continue  # one bucket so far
            rows = [np.concatenate(c) for c in zip(*held)]
            stop = np.searchsorted(rows[0], rows[0][-1])
            yield from (b for b in whole([c[:stop] for c in rows]) if b.num_rows)
            held = [[c[stop:] for c in rows]]
        if held:
            yield from (b for b in whole([np.concatenate(c) for c in zip(*held)]) if b.num_rows)

    return run


def _candidates(nodes: DataFrame, turn: int, similarity: float, each: bool = False) -> DataFrame:
    """(src, dst) of `nodes` (node, fps, component, perhaps n and p0 to p3) that meet by a one-wildcard variant of a segment; `turn` sets the order within buckets."""
    facts = ["component", *[c for c in ("n", "p0", "p1", "p2", "p3") if c in nodes.columns]]
    variants = nodes.select("node", "fps", *facts, F.explode(F.sequence(F.lit(0), F.lit(32 * SEGMENTS - 1))).alias("k"))
    segment = "shiftrightunsigned(get(fps, CAST(k DIV 64 AS INT)), 32 * CAST(k DIV 32 % 2 AS INT))"
    key = f"(CAST(k AS LONG) << 32) | ({segment} & 4294967295L & ~shiftleft(1L, CAST(k % 32 AS INT)))"
    sketch = f"(get(fps, {SEGMENTS // 2}) & -2L) | (shiftrightunsigned({segment}, CAST(k % 32 AS INT)) & 1L)"
    rows = variants.select(F.expr(key).alias("key"), "node", F.expr(sketch).alias("sketch"), *facts)
    order = lambda c: F.xxhash64(F.lit(turn), c) if turn else F.col(c)
    dealt = rows.repartition("key").sortWithinPartitions("key", order("node"))
    found = dealt.mapInArrow(_bucket_mates(SKETCH_BITS, each, similarity), "src long, dst long")
    return cut(found.distinct())


def _verified(known: DataFrame, pairs: DataFrame, similarity: float, size: int) -> DataFrame:
    """Those of `pairs` (src, dst) whose texts' sets of `size`-word shingles have a Jaccard of `similarity` or more; `known` has (node, text)."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for src, a, b in zip(*(batch.column(c) for c in (0, 2, 3))):
                if src.as_py() != last:
                    last, own = src.as_py(), _hashes(_words(a.as_py()), size)
                other = _hashes(_words(b.as_py()), size)
                few, many = sorted((len(own), len(other)))
                both = len(np.intersect1d(own, other, assume_unique=True)) if few >= similarity * many - 1e-9 else 0
                keep.append(both >= similarity * (len(own) + len(other) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a, b = known.select(F.col("node").alias("src"), F.col("text").alias("a")), known.select(F.col("node").alias("dst"), F.col("text").alias("b"))
    met = pairs.join(b, "dst").join(a, "src").select("src", "dst", "a", "b").sortWithinPartitions("src")
    return cut(met.mapInArrow(judge, "src long, dst long"))


def near_duplicate_groups(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, h1, h2, component_id, stays) of every row of `docs` (doc_id, text); h1 and h2 are `row_keys`.

    Two texts are linked if the Jaccard of their sets of `size`-word shingles is at least `similarity`, which is computed for every candidate;
    component_id is the least doc_id that links reach (null where a group has rows without id alone). stays is true for one (doc_id, text)
    of each group: the least by id, null last, then by hash; rows that repeat it are marked alike.

    Candidates share a one-wildcard variant of one of SEGMENTS 32-bit segments of a SimHash of the set of words, so a segment of the two differs by
    one bit at most, and differ in at most SKETCH_BITS of 64 further bits. Variants meet by an equality shuffle. A row that has candidates is verified against
    one of them, and what passes is put together; the same again in another order, between components; then all candidates that are still in different
    components. A bound on the Jaccard from the parities of the shingles' counts leaves out pairs that cannot
    have it. So a large group of near copies leaves few pairs in each turn, and no candidate is passed over.

    Texts of the same words are one node. Null and blank texts are copies of each other; texts of fewer than `size` words are linked to
    copies only. Ids may be null or shared: rows are told apart by id and text. No rows give no rows; only `doc_id` and `text` are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(t.as_py()) for t in batch.column(3)]
            found = [pa.array([_node(w) for w in words], pa.int64()), pa.array([word_fingerprints(w, 1, 1 + SEGMENTS // 2) for w in words], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found], ["doc_id", "h1", "h2", "node", "fps"])

    one, two = row_keys()
    rows = docs.select("doc_id", one.alias("h1"), two.alias("h2"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut(rows.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, node long, fps array<long>"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    nodes = cut(signed.groupBy("node").agg(F.min(first).alias("rep"), F.first("fps").alias("fps")))
    pairs = _candidates(nodes.select("node", "fps", F.col("node").alias("component")), 0, similarity)
    ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    some = cut(nodes.join(ends, "node").select("node", "fps", F.col("rep.h1").alias("k1"), F.col("rep.h2").alias("k2")))
    texts = docs.select("text", one.alias("k1"), two.alias("k2"))
    known = cut(texts.join(small(some.select("node", "k1", "k2")), ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]))
    some = cut(some.select("node", "fps").join(known.mapInArrow(_parities(size), "node long, n long, p0 long, p1 long, p2 long, p3 long"), "node"))
    parts = connected_components(_verified(known, pairs, similarity, size)).withColumnRenamed("id", "node")
    for turn in range(1, TURNS + 1):
        rest = some.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        pairs = _candidates(rest, turn, similarity, each=turn == TURNS)
        stars = parts.select(F.col("node").alias("src"), F.col("component").alias("dst"))  # joins what all links so far do
        parts = connected_components(stars.union(_verified(known, pairs, similarity, size))).withColumnRenamed("id", "node")
    placed = nodes.join(parts, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("least"))
    known = placed.join(least, "root").select("node", "least")
    stays = (F.col("h1") == F.col("least.h1")) & (F.col("h2") == F.col("least.h2"))
    return signed.join(known, "node").select("doc_id", "h1", "h2", F.col("least.doc_id").alias("component_id"), stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """One row of each group of `near_duplicate_groups`, with all columns of `docs`.

    Of rows that repeat an id and a text one stays, the least by all its columns. See `near_duplicate_groups` for the defined cases.
    """
    one, two = row_keys()
    stays = near_duplicate_groups(docs, similarity, size).where("stays").groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.count("*").alias("copies"))
    rows = docs.select(one.alias("k1"), two.alias("k2"), F.struct(*docs.columns).alias("row")).join(stays, ["k1", "k2"])
    alone = rows.where("copies = 1").select("row")
    again = rows.where("copies > 1").withColumn("h", F.xxhash64("row")).groupBy("k1", "k2").agg(F.min_by("row", "h").alias("row")).select("row")
    return alone.union(again).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
