"""Version numbers in table names: ``{alias}_{version}`` (SK4)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: version grammar and range (unsigned 32 bits) ----------------
FIRST_VERSION, MAX_VERSION = 1, 4294967295
VERSION_SUFFIX = r"_\+?([0-9]+)"
# -------------------------------------------------------------------------------


def table_name(alias: str, version: int) -> str:
    return f"{alias}_{version}"


def parse_version(name: str) -> int | None:
    found = re.search(VERSION_SUFFIX + r"\Z", name)
    version = int(found.group(1)) if found else None
    return version if version is not None and version <= MAX_VERSION else None


def next_version(current: int | None) -> int:
    return FIRST_VERSION if current is None else current + 1


def version_of(name: Column) -> Column:
    """The same rule as a column expression, for listings held in a DataFrame."""
    digits = F.nullif(F.regexp_extract(name, VERSION_SUFFIX + r"\z", 1), F.lit(""))
    version = digits.try_cast("bigint")
    return F.when(version <= MAX_VERSION, version)
