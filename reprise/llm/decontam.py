"""Benchmark decontamination over a positional inverted index."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import alnum_words, let
from reprise.llm.positional import agreeing, document_frequencies, small, stands, with_candidates
from reprise.plans.lineage import cut


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(unit, item_id, words) of each distinct item of `benchmark` (item_id, text) that has words."""
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    return items.select(F.xxhash64("item_id", "words").alias("unit"), "item_id", "words")


def benchmark_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(unit, start, t): the windows of each distinct item of `benchmark` (item_id, text); t holds the words.

    A window is `window` consecutive words; an item of fewer words, but not none, is one window. Null texts have none.
    """
    n = F.size("words")
    rows = benchmark_items(benchmark).select("unit", "words", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("start"))
    return rows.select("unit", "start", F.slice("words", F.col("start") + 1, window).alias("t"))


def rare_anchors(windows: DataFrame, frequencies: DataFrame, terms: int = 3) -> DataFrame:
    """`windows` with `anchors`: the item's places of each window's `terms` rarest words, rarest first; ties go to the earlier place."""
    places = windows.select("unit", "start", F.posexplode("t").alias("off", "term")).join(small(frequencies), "term")
    ranked = places.groupBy("unit", "start").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "off"))), 1, terms).alias("r"))
    return windows.join(ranked, ["unit", "start"]).withColumn("anchors", F.transform("r", lambda x: F.col("start") + x["off"])).drop("r")


def _verified(found: Column, ws: Column, window: int, slop: int, least: int) -> Column:
    """struct<n_words, hits, near> of a row's words: which of its candidates hold."""
    spread = lambda c: F.transform(c["starts"], lambda s: F.struct(c["item_id"].alias("item_id"), (c["shift"] + s).alias("doc_start"), s.alias("item_start"), F.slice(c["words"], s + 1, window).alias("t")))
    beside = lambda c, w, i: reduce(or_, [F.get(ws, (c["doc_start"] + i + d).cast("int")).eqNullSafe(w) for d in range(-slop, slop + 1)])
    matched = lambda c: F.size(F.filter(c["t"], lambda w, i: beside(c, w, i)))
    hit = lambda c: [c["item_id"].alias("item_id"), c["doc_start"].alias("doc_start"), c["item_start"].alias("item_start"), F.size(c["t"]).alias("len")]

    def judged(candidates: Column) -> Column:
        exact = F.filter(candidates, lambda c: stands(ws, c["doc_start"], c["t"]))
        rest = F.filter(candidates, lambda c: (F.size(c["t"]) == window) & ~stands(ws, c["doc_start"], c["t"]))
        near = F.filter(F.transform(rest, lambda c: F.struct(*hit(c), matched(c).alias("matched"))), lambda h: h["matched"] >= least)
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.transform(exact, lambda c: F.struct(*hit(c))).alias("hits"), near.alias("near"))

    return let(F.flatten(F.transform(found, spread)), judged)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2, least: int = 8) -> DataFrame:
    """(row, n_words, hits, near) for every row of `docs` (doc_id, text and any others): the benchmark's windows in it.

    row is the whole input row. hits lists (item_id, doc_start, item_start, len) of each place where all words of a window stand
    consecutively. near lists, with `matched`, the places where a whole window does not, but `least` or more of its words stand within `slop` words of
    where they would: passages in which words were inserted, dropped or changed. doc_start of a near hit is where its rarest word puts it.

    One scan counts the document frequency of every benchmark word over all documents. Each window is looked up by its three rarest words: a second
    scan makes postings of those (row, position), shifts each to the place where its item would begin, and keeps the windows of which two or more
    stand at one shift, give or take `slop`. In a third scan the remaining words of these candidates are looked for at their places in
    the row. So no list of a frequent word is made, unless a window has no rarer ones, and no text is shuffled while the
    candidates are few enough to be broadcast.

    Null texts have no words and no hits; rows that repeat are judged each. Items that repeat count once; items without words are
    never found. Frequencies, postings and verification cover whole texts.
    """
    windows = cut(benchmark_windows(benchmark, window))
    frequencies = cut(document_frequencies(docs, cut(windows.select(F.explode("t").alias("term")).distinct())))
    terms = cut(rare_anchors(windows, frequencies).withColumn("k", F.explode("anchors")))
    lookups = cut(terms.select(F.element_at("t", F.col("k") - F.col("start") + 1).alias("term"), "unit", "k").distinct())
    found = agreeing(docs, lookups, slop)
    met = found.join(small(terms), ["unit", "k"]).withColumn("present", F.filter("anchors", lambda a: F.array_contains("near", a)))
    met = met.where((F.size("present") >= F.least(F.lit(2), F.size("anchors"))) & (F.element_at("present", 1) == F.col("k")))
    items = small(cut(benchmark_items(benchmark)))
    at = met.groupBy("h1", "h2", "unit", "shift").agg(F.collect_set("start").alias("starts")).join(items, "unit")
    candidates = cut(at.groupBy("h1", "h2").agg(F.collect_list(F.struct("item_id", "shift", "words", "starts")).alias("found")))
    none = F.array().cast(candidates.schema["found"].dataType)
    rows = with_candidates(docs, candidates).select("row", let(alnum_words(F.col("body")), lambda ws: _verified(F.coalesce("found", none), ws, window, slop, least)).alias("v"))
    return rows.select("row", "v.n_words", "v.hits", "v.near")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2, least: int = 8) -> DataFrame:
    """(row, n_words, n_hit, items, spans, near) for every row of `docs`.

    n_hit counts the words inside any occurrence of a window; items are the item_ids that occur, as strings in order (a null id is not
    listed); spans are the (start, len) of the occurrences; near are the proximity matches, which n_hit and items leave
    out. See `find_passages` for the method and the defined cases.
    """
    found = find_passages(docs, benchmark, window, slop, least)
    spans = F.array_distinct(F.transform("hits", lambda x: F.struct(x["doc_start"].alias("start"), x["len"].alias("len"))))
    items = F.sort_array(F.array_distinct(F.array_compact(F.transform("hits", lambda x: x["item_id"].cast("string")))))
    rows = found.select("row", "n_words", spans.alias("spans"), items.alias("items"), "near")
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    return rows.select("row", "n_words", covered.cast("long").alias("n_hit"), "items", "spans", "near")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window of `benchmark` occurs word by word.

    Null and blank texts stay, as do rows with near hits only; without benchmark items all rows stay.
    """
    clean = find_passages(docs, benchmark, window).where(F.size("hits") == 0)
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
