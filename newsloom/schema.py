"""Fixed schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the six required string fields of a raw article, in order ---
RAW_FIELDS = ("category", "headline", "authors", "link", "short_description", "date")
# How each article field can be matched.
ARTICLE_FIELDS = {
    "category": "keyword",
    "headline": "text",
    "authors": "text",
    "link": "keyword",
    "short_description": "text",
    "date": "date",
    "sentiment_score": "unindexed",
    "sentiment_polarity": "keyword",
}
# Fields and boosts of a search that names no field.
SEARCH_BOOSTS = {"headline": 2.0, "authors": 1.0, "short_description": 1.0}
POSITIVE, NEGATIVE = "Positive", "Negative"
# -------------------------------------------------------------------------------

TEXT_FIELDS = tuple(name for name, kind in ARTICLE_FIELDS.items() if kind == "text")

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType(), False) for name in RAW_FIELDS])

# ``doc_id`` identifies a row within one published version.  ``date`` keeps the
# text as read; ``date_ts`` is the same moment as UTC wall-clock time, which does
# not depend on the session time zone.
ARTICLE_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType(), False)]
    + list(RAW_SCHEMA.fields)
    + [
        T.StructField("date_ts", T.TimestampNTZType(), False),
        T.StructField("sentiment_score", T.FloatType(), False),
        T.StructField("sentiment_polarity", T.StringType(), False),
    ]
)

LEXICON_SCHEMA = T.StructType(
    [
        T.StructField("word", T.StringType(), False),
        T.StructField("valence", T.IntegerType(), False),
    ]
)


def field_kind(field: str, fields: dict[str, str] = ARTICLE_FIELDS) -> str | None:
    """Kind of ``field``; None when it is not part of the schema."""
    kind = fields.get(field)
    if kind == "unindexed":
        raise ValueError(f"field {field!r} is not indexed and cannot be searched")
    return kind


def require_query(query: str) -> str:
    """A query must hold something besides white space."""
    if not query or query.isspace():
        raise ValueError("the query is blank")
    return query
