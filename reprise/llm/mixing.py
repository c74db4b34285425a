"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.llm.common import BLANKS
from reprise.plans.lineage import cut


def word_count(text: Column) -> Column:
    """Words between blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANKS.replace("[", "[^", 1))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row for each source of `sizes` (source, source_size).

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes. A target ends at
    `most` times its source's size; the excess goes to the others by weight until none is above. That is one
    water level: sources are filled in the order of most * size / weight, and the level is where the sum is met.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    rows = sizes.withColumn("rank", rank).withColumn("w", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("w"))
    upto = W.orderBy("fill", F.col("source").asc_nulls_last())
    below, rest = upto.rowsBetween(W.unboundedPreceding, -1), upto.rowsBetween(0, W.unboundedFollowing)
    everyone = W.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(rest))
    # The first source in that order that its share of what is left would not fill sets the level.
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(everyone)["level"]
    target = F.when(level.isNull() | (F.col("fill") <= level), F.col("cap")).otherwise(level * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, seats: str, votes: str, order: list[str], group: list[str]) -> DataFrame:
    """`parties` with `quota`: within each group, `seats` (the group's total, on each row) shared by Sainte-Laguë.

    The seats go to the highest quotients votes / (2 s + 1), ties by `order`. They are not dealt one by one: every
    party first gets its rounded share at a divisor that hands out at most the total and at least the total
    less the number of parties; only the quotients that may still win are listed, at most three for each party on average,
    and ranked. Parties without votes get none.
    """
    g = W.partitionBy(*group)
    v, n = F.col(votes).cast("double"), F.col(seats).cast("double")
    rows = parties.withColumn("_v", F.sum(v).over(g)).withColumn("_p", F.count("*").over(g).cast("double"))
    spare = F.greatest(n - F.col("_p") / 2, F.lit(0.0))
    first = F.when((F.col("_v") > 0) & (spare > 0), F.floor(v * spare / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_first", first)
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_first").over(g))
    reach = F.when(F.col("_v") > 0, F.least(F.ceil(v * F.least(F.col("_p"), n) / F.col("_v") * 2) + 2, F.col("_left"))).otherwise(F.lit(0))
    listed = rows.where((v > 0) & (F.col("_left") > 0)).select(*group, *order, votes, "_first", "_left", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(reach.cast("long") - 1, F.lit(0).cast("long")))).alias("_s"))
    quotient = F.col(votes).cast("double") / (2 * (F.col("_first") + F.col("_s")) + 1)
    by = W.partitionBy(*group).orderBy(quotient.desc(), *[F.col(c).asc_nulls_last() for c in order])
    won = listed.withColumn("_rank", F.row_number().over(by)).where("_rank <= _left").groupBy(*group, *order).agg(F.count("*").alias("_won"))
    a, b = rows.alias("a"), won.alias("b")
    same = F.lit(True)
    for c in dict.fromkeys([*group, *order]):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").select("a.*", "b._won").withColumn("quota", F.col("_first") + F.coalesce("_won", F.lit(0))).drop("_v", "_p", "_first", "_left", "_won")


#: Primes beyond the number of blocks of any shard; a multiplier of them permutes the blocks. Fixed values, the first above 2^24.
_PRIMES = [16777259, 16777289, 16777291, 16777331, 16777333, 16777337, 16777381, 16777421]


def _selected(first: Column, last: Column, blocks: Column, rest: Column, key: Column, before: Column, size: Column, block: int) -> Column:
    """How many of a document's words lie in the blocks that a shard's seeded permutation ranks below `rest`.

    The document's words are `before` to `before + size` of its shard's line, which touch the blocks `first` to `last`.
    """
    prime = F.element_at(F.array(*[F.lit(p) for p in _PRIMES]), (F.pmod(key, F.lit(len(_PRIMES))) + 1).cast("int")).cast("long")
    rank = lambda b: F.pmod(prime * b + F.pmod(F.shiftright(key, 8), blocks), blocks)
    overlap = lambda b: F.least(before + size, (b + 1) * block) - F.greatest(before, b * block)
    step = lambda n, b: n + F.when(rank(b) < rest, overlap(b)).otherwise(F.lit(0).cast("long"))
    return F.when((size > 0) & (rest > 0), F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), step)).otherwise(F.lit(0).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 16, shard_words: int = 1_000_000, seed: int = 17, fan: int = 1024) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `docs` (doc_id, text, source).

    Blocks of `block` words are apportioned to the sources by their targets, within a source to its ranges of `fan` shards and
    within a range to its shards by size, each by highest Sainte-Laguë quotients. A shard holds about `shard_words` words of one
    source, chosen by a hash of the row, so that a source of any size is cut into tasks of one size; `fan` bounds the parties of an
    apportionment, but that of the sources, which are ranked in one task. A shard's documents stand in a line in seeded order,
    cut into equal blocks. It takes whole passes over all its blocks and, of the rest of its quota, the blocks that a permutation seeded by
    source, shard and `seed` ranks first. taken counts a document's words in taken blocks with repeats and never exceeds `most` times the size.

    Sizes are counted in one scan and kept; all later steps move ids and numbers only. A null or blank text has size 0 and
    takes 0; a null source is a source of its own; rows that repeat are mixed each (equal rows are interchangeable); no
    rows give no rows. The order and the shards depend on id, text and seed alone, so reruns agree.
    """
    mixed = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mixed.alias("h")))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(by_source, weights, share, most)
    total = F.floor(F.sum("target").over(W.partitionBy()) / block).cast("long")
    blocks = apportion(targets.withColumn("_n", total), "_n", "target", ["source"], []).drop("_n")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    plan = cut(blocks.select("source", "source_size", "target", F.col("quota").alias("blocks"), shards.alias("shards")))
    placed = _with(sized, plan, ["source"]).withColumn("shard", F.pmod(F.shiftright("h", 20), F.col("shards"))).withColumn("range", F.floor(F.col("shard") / fan))
    by_shard = cut(placed.groupBy("source", "range", "shard", "blocks").agg(F.sum("size").alias("shard_size")))
    ranges = by_shard.groupBy("source", "range", "blocks").agg(F.sum("shard_size").alias("range_size"))
    ranges = apportion(ranges, "blocks", "range_size", ["range"], ["source"]).select("source", "range", F.col("quota").alias("part"))
    quotas = apportion(_with(by_shard, ranges, ["source", "range"]), "part", "shard_size", ["shard"], ["source", "range"])
    cells = F.ceil(F.col("shard_size") / block).cast("long")
    quotas = quotas.select("source", "shard", cells.alias("cells"), F.least("quota", (cells * most).cast("long")).alias("quota"), F.xxhash64(F.lit(seed + 1), F.coalesce("source", F.lit("")), F.col("source").isNull(), "shard").alias("key"))
    rows = _with(placed, quotas, ["source", "shard"])
    line = W.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    passes = F.expr("CASE WHEN cells > 0 THEN quota DIV cells ELSE 0 END")
    first, last = F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("size") - 1) / block)
    rest = F.col("quota") - passes * F.col("cells")
    picked = _selected(first, F.greatest(first, last), F.col("cells"), rest, F.col("key"), F.col("before"), F.col("size"), block)
    return rows.select("doc_id", "size", "source_size", "target", (passes * F.col("size") + picked).cast("long").alias("taken"))


def _with(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the columns of `other`, on null-safe keys."""
    a, b = rows.alias("a"), other.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select("a.*", *[F.col(f"b.{c}") for c in other.columns if c not in keys])
