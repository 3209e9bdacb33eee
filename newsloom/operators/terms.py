"""Counts per value of a keyword column (AG1 - AG3, AG6, SL2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.match import DEFAULT_FIELD, match

# --- fixed value: buckets returned when a request names no size ----------------
TOP_BUCKETS = 10
# -------------------------------------------------------------------------------


def _buckets(df: DataFrame, column: str) -> DataFrame:
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"))
    return counted.agg(F.count("*").alias("doc_count"))


def top_terms(df: DataFrame, column: str, size: int = TOP_BUCKETS) -> DataFrame:
    """``key, doc_count`` of the ``size`` most frequent values, ties by key."""
    return _buckets(df, column).orderBy(F.desc("doc_count"), "key").limit(size)


def terms_remainder(df: DataFrame, column: str, size: int = TOP_BUCKETS) -> DataFrame:
    """One row: rows outside the top buckets, and the (zero) counting error."""
    buckets = _buckets(df, column)
    top = buckets.orderBy(F.desc("doc_count"), "key").limit(size)
    in_top = top.agg(F.coalesce(F.sum("doc_count"), F.lit(0))).scalar()
    total = F.coalesce(F.sum("doc_count"), F.lit(0))
    return buckets.agg(total.alias("total")).select(
        (F.col("total") - in_top).alias("sum_other_doc_count"),
        F.lit(0).cast("bigint").alias("doc_count_error_upper_bound"),
    )


def sentiment_stats(
    articles: DataFrame, query: str | None = None, field: str = DEFAULT_FIELD, size: int = TOP_BUCKETS
) -> DataFrame:
    """Articles per sentiment, of those matching the query or of all."""
    return top_terms(match(articles, query, field), "sentiment_polarity", size)


def category_stats(
    articles: DataFrame, query: str | None = None, field: str = DEFAULT_FIELD, size: int = TOP_BUCKETS
) -> DataFrame:
    """Articles per category, of those matching the query or of all."""
    return top_terms(match(articles, query, field), "category", size)
