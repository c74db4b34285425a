"""A corpus pipeline of five operators: each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import table
from reprise.llm.decontam import drop_contaminated
from reprise.llm.mixing import mix_sources
from reprise.llm.repeats import remove_repeats
from reprise.llm.simhash import drop_near_duplicates
from reprise.llm.toxicity import drop_toxic, fit_toxicity
from reprise.plans.lineage import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. The model is fitted on the labelled ones among them."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: that of the least doc_id, null last. Rows are told apart by id and text, not by id alone."""
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that lie in 100-byte strings which occurred before; n_chars follows the text."""
    found = remove_repeats(docs, as_text=True)
    own = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[own.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL cannot express the trained classifier, the connected components or the seeded choice; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`. Stages in between are kept in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
