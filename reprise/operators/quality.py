"""Profiling and eligibility cleaning of raw tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.functions.rules import MEANINGLESS

#: Why a row is dropped, in the order in which reasons count.
REASONS = ("null", "duplicate", "low_module", "kept")


def missing_profile(rows: DataFrame) -> DataFrame:
    """(column, n_null, n_empty, pct_null, pct_empty) for every column, in one pass; percentages to two places, half to even."""
    n = F.count("*")
    cells = []
    for c in rows.columns:
        blank = F.count_if(F.trim(F.col(c).cast("string")) == "")
        null = F.count_if(F.col(c).isNull())
        pct = lambda k: F.coalesce(F.bround(F.try_divide(k * 100, n), 2), F.lit(0.0))
        cells.append(F.struct(F.lit(c).alias("column"), null.alias("n_null"), blank.alias("n_empty"), pct(null).alias("pct_null"), pct(blank).alias("pct_empty")))
    return rows.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def repeated_texts(rows: DataFrame, key: str, text: str, examples: int = 5) -> DataFrame:
    """(text, n, examples): texts of more than one distinct key, with the least few keys.

    Keys are ranked within a text first, so only `examples` of them are gathered however common the text is.
    """
    pairs = rows.where(F.col(text).isNotNull()).select(text, key).distinct()
    ranked = pairs.withColumn("_r", F.row_number().over(W.partitionBy(text).orderBy(key)))
    counts = pairs.groupBy(text).agg(F.count("*").alias("n")).where("n > 1")
    few = ranked.where(F.col("_r") <= examples).groupBy(text).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return counts.join(few, text)


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def mark_eligibility(rows: DataFrame, required: list[str], text: str, module: str, order: list[str], min_tickets: int = 1154) -> DataFrame:
    """`rows` with `reason`: null, duplicate, low_module or kept; the first that applies.

    Blank required columns drop a row; of equal trimmed texts among the rest the first by `order` stays; modules with fewer than
    min_tickets rows left are dropped as a whole.
    """
    missing = F.lit(False)
    for c in required:
        missing = missing | _blank(c)
    rows = rows.withColumn("_missing", missing).withColumn("_text", F.trim(F.col(text)))
    good = rows.where("NOT _missing")
    rank = F.row_number().over(W.partitionBy("_text").orderBy(*order))
    good = good.withColumn("_copy", rank > 1)
    left = F.count_if(~F.col("_copy")).over(W.partitionBy(module))
    good = good.withColumn("reason", F.when(F.col("_copy"), "duplicate").when(left < min_tickets, "low_module").otherwise("kept"))
    bad = rows.where("_missing").withColumn("reason", F.lit("null"))
    return good.drop("_missing", "_text", "_copy").unionByName(bad.drop("_missing", "_text"))


def module_coverage(marked: DataFrame, module: str) -> DataFrame:
    """(module, before, after, coverage_pct, status) of marked rows; Layak where anything is kept, else Tidak Layak."""
    kept = F.count_if(F.col("reason") == "kept")
    return marked.groupBy(module).agg(F.count("*").alias("before"), kept.alias("after"), F.bround(kept * 100 / F.count("*"), 2).alias("coverage_pct"), F.when(kept > 0, "Layak").otherwise("Tidak Layak").alias("status"))


def is_meaningless(text: Column, min_chars: int = 5, min_words: int = 2, stoplist: list[str] | None = None) -> Column:
    """Whether a text says nothing: null, too short, in the stop list, only punctuation, a few letters, digits, or keys struck in a row."""
    t = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    words = F.size(F.array_remove(F.split(t, r"(?U)\s+"), ""))
    listed = t.isin([w.strip().lower() for w in (stoplist if stoplist is not None else MEANINGLESS)])
    return text.isNull() | (F.length(t) < min_chars) | (words < min_words) | listed | t.rlike(r"^[-\.\?]{2,}$") | t.rlike(r"^[a-z]{1,4}$") | t.rlike(r"^[0-9]+$") | t.rlike(r"(asd|qwe|zxc){2,}")


def word_limit(rows: DataFrame, text: str, most: int) -> DataFrame:
    """Rows of at most `most` blank-separated words, with n_words."""
    n = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), ""))
    return rows.withColumn("n_words", n).where(F.col("n_words") <= most)
