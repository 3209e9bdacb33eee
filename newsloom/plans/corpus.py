"""Articles made from the ``documents`` table of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_date

# --- fixed values: first day of the derived dates, and their number ------------
FIRST_DAY, N_DAYS = "2018-01-01", 365
# -------------------------------------------------------------------------------


def raw_columns() -> list[Column]:
    """The six raw article fields, from columns of ``documents``."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % N_DAYS).cast("int"))
    return [
        F.col("source").alias("category"),
        F.substring_index("text", "\n", 1).alias("headline"),
        F.col("lang").alias("authors"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("link"),
        F.col("text").alias("short_description"),
        day.cast("string").alias("date"),
    ]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def articles_from_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, the six raw fields and ``date_ts``; a projection only."""
    return docs.select("doc_id", *raw_columns()).withColumn("date_ts", parse_date(F.col("date")))
