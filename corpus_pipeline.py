"""The corpus pipeline: documents through the operators, stage by stage.

Defined results, for every stage: rows without an id are judged like others; repeated rows
are judged alike, and of equal texts near duplicates keep one row; a NULL or empty text fails
the quality rules, and would pass the other stages (near duplicates keep one of them);
texts are taken whole, however long; an empty table gives an empty one, and without labels
or benchmark items the stages that need them reject nothing by them.  Further columns are
kept up to the last stage, whatever their names; that one returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, pieces, quality_rules, secrets, simhash
from newsloom.llm.common import read_table, stored


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejects what fails the quality rules."""
    return quality_rules.keep(docs, quality_rules.fit(docs, read_table(spark, folder, "labels")))


def duplicates_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return simhash.deduplicate(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, read_table(spark, folder, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Puts a mark in place of every secret; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def pieces_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Encodes what is left, and decodes it again."""
    return pieces.digests(docs, pieces.read_model(pieces.public_model()))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", duplicates_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secrets_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL cannot express the stages with trained trees, fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The result of the last stage; every stage is written and read again by the next."""
    docs = read_table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs
