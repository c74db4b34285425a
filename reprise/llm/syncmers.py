"""Document fingerprints from closed syncmers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.llm.common import let

#: A k-mer is KMER code points, its inner substrings have INNER: five of them, so that two in five k-mers are chosen.
KMER, INNER = 12, 8


def _cut(points: Column, at: Column, size: int) -> Column:
    """`size` code points of a text in UTF-32, four bytes each, from the place `at` on: a copy of a few bytes wherever it stands."""
    return F.substring(points, (at * 4 + 1).cast("int"), F.lit(4 * size))


def _upto(n: Column) -> Column:
    """The places 0 to n - 1; none if n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _closed(points: Column) -> Column:
    """The places of the closed syncmers of a text in UTF-32, in order."""
    last = KMER - INNER
    edge = lambda s, i: F.least(F.get(s, i), F.get(s, i + last)) <= F.least(*[F.get(s, i + j) for j in range(1, last)])
    hashes = F.transform(_upto(_size(points) - INNER + 1), lambda i: F.xxhash64(_cut(points, i, INNER)))
    return let(hashes, lambda s: F.filter(_upto(F.size(s) - last), lambda i: edge(s, i)))


def _size(points: Column) -> Column:
    return (F.octet_length(points) / 4).cast("int")


def _points(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-32")


def _chosen(points: Column, kept: Column | None = None, start: Column | None = None) -> Column:
    """The places of a text's anchors: closed syncmers, or 0 for a text too short for one that is not empty.

    Places before `start` are known to be `kept`, so only the rest is looked at: what is an anchor does not depend on what surrounds it.
    """
    n = _size(points)
    if start is None:
        return F.when(n >= KMER, _closed(points)).otherwise(_upto(F.least(n, F.lit(1))))
    rest = let(F.substring(points, (start * 4 + 1).cast("int"), F.octet_length(points)), _closed)
    return F.when(n >= KMER, F.concat(kept, F.transform(rest, lambda i: i + start))).otherwise(_upto(F.least(n, F.lit(1))))


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>>: the closed syncmers of a text, at code points from 0.

    A run of KMER code points is an anchor if the least hash among its substrings of INNER is that of the first or the last one. Whether it
    is depends on these characters alone, so equal runs are anchors wherever they stand. A text of fewer is one anchor as a whole; null
    and empty texts have none. All anchors of the whole text are kept.
    """
    found = lambda points: F.transform(_chosen(points), lambda i: F.struct(i.alias("pos"), F.xxhash64(_cut(points, i, KMER)).alias("hash")))
    return let(_points(text), found)


def _linked(points: Column, at: Column, first: Column) -> Column:
    """A hash for each anchor from the `first` on, in order: of its characters, the next anchor's and the distance between them."""
    link = lambda p, q: F.xxhash64(_cut(points, p, KMER), F.when(q.isNotNull(), _cut(points, q, KMER)), q - p)
    return F.transform(_upto(F.size(at) - first), lambda i: link(F.get(at, first + i), F.get(at, first + i + 1)))


def _printed(at: Column, places: Column) -> Column:
    """struct<fingerprint, at, places, again>: the digest of all anchors, their places, their links, and of the links each occurrence after the first."""
    half = lambda *c: F.lower(F.lpad(F.hex(F.xxhash64(*c)), 16, "0"))
    digest = F.when(F.size(at) == 0, F.lit("")).otherwise(F.concat(half(at, places), half(F.lit(1), at, places)))
    repeated = let(F.sort_array(places), lambda s: F.filter(s, lambda x, i: x.eqNullSafe(F.get(s, i + 1))))
    again = F.when(F.size(F.array_distinct(places)) == F.size(places), F.array().cast("array<long>")).otherwise(repeated)
    return F.struct(digest.alias("fingerprint"), at.alias("at"), places.alias("places"), again.alias("again"))


def prints(text: Column) -> Column:
    """struct<fingerprint, at, places, again> over all anchors of a text.

    places has a hash for each anchor, in order: of its characters, the next anchor's and the distance between them. It holds what stands where
    relative to its neighbour, so a passage has the same ones wherever it stands. fingerprint is a digest of all of them with
    their positions, 32 hex digits, and empty without anchors.
    """
    zero = F.lit(0)
    return let(_points(text), lambda points: let(_chosen(points), lambda at: let(_linked(points, at, zero), lambda places: _printed(at, places))))


def edited_prints(own: Column, edited: Column, keep: Column) -> Column:
    """`prints` of a text that begins with the first `keep` code points of one whose prints are `own`, whose anchors there it shares."""
    start = F.greatest(keep - KMER + 1, F.lit(0))
    shared = F.filter(own["at"], lambda p: p + KMER <= keep)

    def whole(points: Column, kept: Column) -> Column:
        same = F.greatest(F.size(kept) - 1, F.lit(0))  # the last kept one may have another neighbour
        links = lambda at: F.concat(F.slice(own["places"], F.lit(1), same), _linked(points, at, same))
        return let(_chosen(points, kept, start), lambda at: let(links(at), lambda places: _printed(at, places)))

    return let(_points(edited), lambda points: let(shared, lambda kept: whole(points, kept)))


def _matched(a: Column, b: Column) -> Column:
    """The size of the intersection of two lists, each occurrence counted; one fold over both in order, the last bit of a hash tells the list."""
    even = F.lit(-2).cast("long")
    both = F.sort_array(F.concat(F.transform(a, lambda x: x.bitwiseAND(even)), F.transform(b, lambda x: x.bitwiseOR(F.lit(1).cast("long")))))
    state = lambda key, left, n: F.struct(key.alias("key"), left.alias("left"), n.alias("n"))

    def step(s: Column, x: Column) -> Column:
        base = x.bitwiseAND(even)
        first, same = base == x, base == s["key"]
        found = state(s["key"], s["left"] - 1, s["n"] + 1)
        return F.when(first & same, state(s["key"], s["left"] + 1, s["n"])).when(first, state(base, F.lit(1), s["n"])).when(same & (s["left"] > 0), found).otherwise(s)

    return F.aggregate(both, state(F.lit(0).cast("long"), F.lit(0), F.lit(0)), step, lambda s: s["n"])


def likeness(a: Column, b: Column) -> Column:
    """The share of all anchors of two texts that stand in both at the same distance from the same next anchor, from 0 to 1.

    `a` and `b` are `prints`. Each occurrence is matched once at most; two texts without anchors are alike. Different links are matched as
    sets; of a link that both have, the occurrences after the first are matched among themselves, which are few.
    """
    common = F.size(F.array_intersect(a["places"], b["places"])) + F.when((F.size(a["again"]) > 0) & (F.size(b["again"]) > 0), _matched(a["again"], b["again"])).otherwise(F.lit(0))
    total = F.size(a["places"]) + F.size(b["places"])
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * common / total)


def _with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, prints, next_text, next_prints): each row with the one after it by id, the last with the first.

    Ids are cut into ranges at quantiles, which are ids that occur. The rows at the lower end of a range are also sent to the range
    before it, so each range finds all its successors by itself and the texts are shuffled once. Rows
    of one id follow each other by text; a null id comes first.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ends = docs.agg(F.min(key).alias("lo"), F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first() if parts > 1 else docs.agg(F.min(key).alias("lo"), F.lit(None).alias("q")).first()
    bounds = sorted({ends["lo"], *(ends["q"] or [])}) if ends["lo"] is not None else [0]
    listed, last = F.array(*[F.lit(b) for b in bounds]), len(bounds)
    steps = [1 << s for s in reversed(range(last.bit_length()))]
    place = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= last) & (F.coalesce(F.get(listed, at + s - 1), F.lit(0)) <= F.col("key")), at + s).otherwise(at))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key")).withColumn("part", place)
    copy = lambda part, late: F.struct(part.cast("int").alias("part"), F.lit(late).alias("late"))
    own = copy(F.col("part"), 0)
    at_edge = F.get(listed, F.col("part") - 1) == F.col("key")
    sent = F.when(at_edge & (F.col("part") == 1), F.array(own, copy(F.lit(last), 2))).when(at_edge, F.array(own, copy(F.col("part") - 1, 1))).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "key", F.explode(sent).alias("c")).select("doc_id", "text", "key", F.col("c.part").alias("part"), F.col("c.late").alias("late")).repartition("part")
    dealt = dealt.withColumn("prints", prints(F.col("text"))).withColumn("tie", F.xxhash64("text"))
    order = W.partitionBy("part").orderBy("late", "key", "tie")
    near = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_prints", F.lead(F.struct("prints.places", "prints.again")).over(order))
    return near.where("late = 0").select("doc_id", "text", "prints", "next_text", "next_prints")


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every row of `docs` (doc_id, text) and of its edited text, with likenesses.

    The edited text has its last quarter (floor of n_chars / 4 code points) replaced by the first as many code points, or
    all, of the next document by ascending doc_id; after the last comes the first. Result: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty; empty texts have an
    empty fingerprint, and two of them are alike (1.0). Equal texts have equal fingerprints. `parts` is the number of id
    ranges, four for each shuffle partition unless given.
    """
    if parts is None:
        parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = _with_next(docs, parts)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "prints", "next_prints", (n - quarter).alias("keep"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "prints", "next_prints", edited_prints(F.col("prints"), F.col("edited"), F.col("keep")).alias("edited_prints"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "prints.fingerprint", F.col("edited_prints.fingerprint").alias("edited_fingerprint"), likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"))
