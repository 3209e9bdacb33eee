"""Filters: the query part of every request (PF2 - PF5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import date_period
from newsloom.functions.text import has_any_token, query_tokens
from newsloom.schema import ARTICLE_FIELDS, field_kind, require_query

DEFAULT_FIELD = "short_description"


def match_condition(
    df: DataFrame, field: str, query: str, fields: dict[str, str] = ARTICLE_FIELDS
) -> Column:
    """Condition under which a row of ``df`` matches ``query`` on ``field``.

    text: any token of the query occurs as a token; keyword: the whole value is
    equal; date: the moment lies in the period the query names; a field outside
    the schema matches nothing.
    """
    require_query(query)
    kind = field_kind(field, fields)
    if kind == "text":
        return has_any_token(F.col(field), query_tokens(df.sparkSession, query))
    if kind == "keyword":
        return F.col(field) == query
    if kind == "date":
        low, high = date_period(query)
        if df.sparkSession.range(1).select(low.isNull()).first()[0]:
            raise ValueError(f"not a date: {query!r}")
        moment = F.col(moment_column(field, df))
        return (moment >= low) & (moment < high)
    return F.lit(False)


def moment_column(field: str, df: DataFrame) -> str:
    """Column holding the parsed moment of a date field."""
    parsed = f"{field}_ts"
    return parsed if parsed in df.columns else field


def match(
    df: DataFrame,
    query: str | None = None,
    field: str = DEFAULT_FIELD,
    fields: dict[str, str] = ARTICLE_FIELDS,
) -> DataFrame:
    """Rows of ``df`` matching ``query``; all rows when there is no query."""
    return df if query is None else df.where(match_condition(df, field, query, fields))
