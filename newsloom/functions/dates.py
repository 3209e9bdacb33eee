"""Date strings of the article schema (SF5, PF4).

Accepted: ``yyyy[-MM[-dd[THH[:mm[:ss[.fraction]]][zone]]]]`` with zone ``Z``,
``+hh``, ``+hhmm`` or ``+hh:mm``, and epoch milliseconds (a run of digits that
is not four digits long, up to the largest moment a timestamp holds).  Instants are
kept to the millisecond as UTC wall-clock ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: date grammar ------------------------------------------------
_TIME = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?"
_ZONE = r"Z|[+-]\d{2}(?::?\d{2})?"
ISO = rf"\d{{4}}(?:-\d{{2}}(?:-\d{{2}}(?:T{_TIME}(?:{_ZONE})?)?)?)?"
DAY = r"\d{4}-\d{2}-\d{2}"
EPOCH_MILLIS = r"\d{1,3}|\d{5,19}"
# The last millisecond of a timestamp of 64-bit microseconds.
MAX_MILLIS = 9_223_372_036_854_775
# -------------------------------------------------------------------------------


def _is(text: Column, grammar: str) -> Column:
    return text.rlike(rf"^(?:{grammar})\z")


def parse_date(text: Column) -> Column:
    """Moment of a date string as ``TIMESTAMP_NTZ`` in UTC, NULL if refused."""
    local = F.regexp_replace(text, rf"(?:{_ZONE})$", "")
    local = F.when(text.contains("T"), local).otherwise(text)
    local = F.regexp_replace(F.translate(local, ",", "."), r"(\.\d{3})\d+$", "$1")
    zone = F.when(text.contains("T"), F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})?$", 0))
    sign = F.when(F.substring(zone, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hours = F.substring(zone, 2, 2).try_cast("int")
    minutes = F.coalesce(
        F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0)
    )
    shift = F.make_dt_interval(hours=F.lit(0), mins=sign * (hours * 60 + minutes))
    moment = local.try_cast("timestamp_ntz")
    iso = F.when(hours.isNull(), moment).when(
        (hours <= 18) & (minutes <= 59), moment - shift
    )
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01'")
    # Microseconds beyond 64 bits are no moment a timestamp holds.
    millis = text.try_cast("bigint")
    millis = F.when(millis <= MAX_MILLIS, millis)
    days = F.call_function("div", millis, F.lit(86_400_000)).cast("int")
    seconds = ((millis % F.lit(86_400_000)) / F.lit(1000)).cast("decimal(18,6)")
    moment_of_epoch = epoch + F.make_dt_interval(days=days, secs=seconds)
    return (
        F.when(_is(text, DAY), text.try_cast("timestamp_ntz"))
        .when(_is(text, ISO), iso)
        .when(_is(text, EPOCH_MILLIS), moment_of_epoch)
    )


# --- fixed values: period covered by a query date, by the parts it names -------
_PERIODS = {
    "year": "INTERVAL 1 YEAR",
    "month": "INTERVAL 1 MONTH",
    "day": "INTERVAL 1 DAY",
    "hour": "INTERVAL 1 HOUR",
    "minute": "INTERVAL 1 MINUTE",
    "second": "INTERVAL 1 SECOND",
    "millisecond": "INTERVAL '0.001' SECOND",
}
# -------------------------------------------------------------------------------


def date_period(query: str) -> tuple[Column, Column]:
    """Half-open period ``[low, high)`` covered by a query date.

    A partial date covers all of the year, month, ... it names.  Both bounds are
    constant expressions, which the optimizer folds and pushes to the scan.
    """
    if re.fullmatch(EPOCH_MILLIS, query, re.ASCII):
        precision = "millisecond"
    elif re.fullmatch(ISO, query, re.ASCII):
        day, _, clock = query.partition("T")
        clock = re.sub(rf"(?:{_ZONE})$", "", clock)
        if "." in clock or "," in clock:
            precision = "millisecond"
        else:
            dated, timed = len(day.split("-")), len(clock.split(":")) if clock else 0
            precision = list(_PERIODS)[dated + timed - 1]
    else:
        raise ValueError(f"not a date: {query!r}")
    low = parse_date(F.lit(query))
    return low, low + F.expr(_PERIODS[precision])
