"""Pieces that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the whitespace contract: U+0020 and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
#: Separators of the alphanumeric contract: ASCII other than digits and letters.
NON_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the fast path; other letters would change under lower()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def blank_words(text: Column) -> Column:
    """The words between blanks, in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def alnum_words(text: Column) -> Column:
    """The lower-cased words between ASCII separators, in order; null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_ALNUM), "")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def row_keys() -> tuple[Column, Column]:
    """Two 64-bit hashes that tell rows apart by doc_id and text, whether ids are null or shared; rows that repeat both have the same."""
    return F.xxhash64(F.lit(1), "doc_id", "text"), F.xxhash64(F.lit(2), "doc_id", "text")


def let(value: Column, body) -> Column:
    """`body(v)` with `value` computed once per row, also where lambdas inside `body` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)
