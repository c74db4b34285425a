"""Delimited files: delimiter and encoding detection on a bounded sample, tolerant reading, column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Candidate delimiters, in order of preference at ties.
DELIMITERS = (",", ";", "|", "\t")
#: Encodings that are tried in order.
ENCODINGS = ("utf-8", "cp1252", "latin-1")
#: How much of a file the detection looks at.
SAMPLE_BYTES = 65536

#: The canonical ticket columns, in order. Fixed values.
TICKET_COLUMNS = ["tgl_submit", "incident_number", "site", "assignee", "modul", "sub_modul", "detailed_decription"]


def sample_bytes(spark: SparkSession, path: str, limit: int = SAMPLE_BYTES) -> bytes:
    """The first bytes of a file, by Spark's own file access, so that any store works."""
    rows = spark.read.text(path).limit(200).collect()
    return "\n".join(r[0] for r in rows).encode()[:limit]


def detect_delimiter(sample: str) -> str:
    """The candidate that splits the most lines into one number of fields, more than one; else the most frequent one."""
    lines = [x for x in sample.splitlines() if x.strip()][:50]
    def fitness(d: str) -> tuple[int, int]:
        counts = [x.count(d) for x in lines]
        usual = max(set(counts), key=counts.count) if counts else 0
        return (counts.count(usual) if usual else 0, usual)

    best = max(DELIMITERS, key=fitness)
    return best if fitness(best)[0] else detect_delimiter_by_count(sample)


def detect_delimiter_by_count(sample: str, chars: int = 5000) -> str:
    """The candidate that occurs most often in the first `chars` characters."""
    return max(DELIMITERS, key=sample[:chars].count)


def detect_encoding(sample: bytes) -> str:
    """The first of ENCODINGS that decodes the sample; a character cut off at its end does not count."""
    for name in ENCODINGS:
        try:
            sample.decode(name)
        except UnicodeDecodeError as e:
            if name == "utf-8" and e.start >= len(sample) - 3 and "end of data" in e.reason:
                return name
            continue
        return name
    return ENCODINGS[-1]


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """A delimited file with a header, every column a string as written; blanks stay blank."""
    sep = delimiter or detect_delimiter(sample_bytes(spark, path).decode("utf-8", "replace"))
    rows = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, nullValue="\u0000", emptyValue="", multiLine=True, quote='"', escape='"')
    return rows.fillna("")  # the reader gives null for a field without characters


def read_csv_tolerant(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", encoding: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): rows of `columns` strings; skipped has the number of lines of another number of fields."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    raw = spark.read.option("columnPruning", False).csv(path, header=True, sep=delimiter, encoding=encoding, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True)
    good = raw.where("_corrupt IS NULL").drop("_corrupt")
    return good, raw.agg(F.count_if(F.col("_corrupt").isNotNull() & (F.coalesce(F.col(columns[0]), F.lit("")) >= "")).alias("n_skipped"))


def rename_by_alias(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns that are called like an alias, whatever the case, get the standard name; the first that fits wins."""
    have = {c.strip().lower(): c for c in rows.columns}
    renames = {}
    for standard, names in aliases.items():
        if standard in rows.columns:
            continue
        found = next((have[n.lower()] for n in [standard, *names] if n.lower() in have), None)
        if found is not None and found not in renames:
            renames[found] = standard
    return rows.withColumnsRenamed(renames)


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in rows.columns]


def canonical(rows: DataFrame) -> DataFrame:
    """The ticket columns as trimmed strings; absent ones are null, and so are the texts None, nan and NaN."""
    def one(c: str):
        if c not in rows.columns:
            return F.lit(None).cast("string").alias(c)
        t = F.trim(F.col(c).cast("string"))
        return F.when(~t.isin("", "None", "nan", "NaN"), t).alias(c)

    return rows.select(*map(one, TICKET_COLUMNS))


def parse_time(value, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")):
    """A time from text, by the first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])


def resample_rows(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About `n` rows drawn with replacement."""
    total = rows.count()
    return rows.sample(withReplacement=True, fraction=n / total, seed=seed) if total else rows


def shuffle_columns(rows: DataFrame, key: str, columns: list[str], seed: int = 42) -> DataFrame:
    """`rows` with the values of each column dealt anew, independently: ranks within key ranges, so that no task gets them all.

    Each column's values are dealt within blocks of the key's hash; the blocks differ by column.
    """
    out = rows.select(key)
    from pyspark.sql import Window as W

    for i, c in enumerate(columns):
        block = F.pmod(F.xxhash64(F.lit(seed + i), key), F.lit(64))
        a = rows.select(key, block.alias("_b")).withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(key)))
        b = rows.select(F.col(c), block.alias("_b"), F.col(key).alias("_k")).withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed * 31 + i), "_k"), "_k"))).drop("_k")
        out = out.join(a.join(b, ["_b", "_r"]).select(key, c), key)
    return out
