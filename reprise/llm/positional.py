"""Positional inverted lists, shared by decontamination and license scans.

A posting says at which place of which row a term stands; shifted by the term's place in a unit (a benchmark item, a license
template) it says where the unit would begin. Terms of one unit that stand as the unit has them agree in that shift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.llm.common import alnum_words, row_keys

#: A broadcast side may have so many bytes as JSON; beyond that the same join shuffles.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, which is kept already, marked for broadcast where its measured size allows."""
    size = df.select(F.length(F.to_json(F.struct(*df.columns))).alias("n")).agg(F.sum("n")).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): in how many rows of `docs` each of `terms` (term) occurs, over all rows; 0 where in none."""
    seen = docs.select(F.explode(F.array_distinct(alnum_words(F.col("text")))).alias("term")).join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("df"))


def agreeing(docs: DataFrame, lookups: DataFrame, reach: int, terms=None) -> DataFrame:
    """(h1, h2, unit, k, shift, near) for every posting of a looked-up term: near lists the k of its unit that stand within `reach` of its shift.

    `lookups` (term, unit, k) is kept already and says at which places of which units a term is looked up. h1 and h2 are `row_keys`.
    `terms`, if given, maps a row's words to those that are looked up in it. Postings hold positions only and are shuffled once, by row
    and unit, so a term on a third of all rows is spread over these rows. Rows that repeat have the same postings, which count once.
    """
    places = lookups.groupBy("term").agg(F.collect_set(F.struct("unit", "k")).alias("places"))
    one, two = row_keys()
    words = docs.select(one.alias("h1"), two.alias("h2"), alnum_words(F.col("text")).alias("ws"))
    if terms is not None:
        words = words.withColumn("wanted", terms(F.col("ws"))).where(F.size("wanted") > 0)
        found = words.select("h1", "h2", "wanted", F.posexplode("ws").alias("pos", "term")).join(small(places), "term")
        found = found.where(F.array_contains("wanted", F.col("term")))
    else:
        found = words.select("h1", "h2", F.posexplode("ws").alias("pos", "term")).join(small(places), "term")
    found = found.select("h1", "h2", "pos", F.explode("places").alias("p"))
    found = found.select("h1", "h2", F.col("p.unit").alias("unit"), F.col("p.k").alias("k"), (F.col("pos") - F.col("p.k")).cast("long").alias("shift"))
    dealt = found.repartition("h1", "h2", "unit").distinct()
    around = W.partitionBy("h1", "h2", "unit").orderBy("shift").rangeBetween(-reach, reach)
    return dealt.withColumn("near", F.collect_set("k").over(around))


def stands(words: Column, place: Column, phrase: Column) -> Column:
    """Whether the words of `phrase` stand consecutively in `words` from `place` on."""
    return F.size(F.filter(phrase, lambda w, i: F.get(words, (place + i).cast("int")).eqNullSafe(w))) == F.size(phrase)


def with_candidates(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(row, ws, found): every row of `docs` as a struct, with its words where it has candidates and the list of these, else null.

    `candidates` (h1, h2, found) is kept already. Rows that repeat are all there.
    """
    one, two = row_keys()
    rows = docs.select(F.struct(*docs.columns).alias("row"), one.alias("h1"), two.alias("h2"), F.col("text").alias("body"))
    return rows.join(small(candidates), ["h1", "h2"], "left").select("row", "body", "found")
