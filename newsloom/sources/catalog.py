"""Small texts kept as views of Spark's catalog, where renaming a file is not one step."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_SEPARATOR = "__"


class CatalogTexts:
    """Texts under one name, each a view ``{name}__{text name}`` of a database.

    Has the methods of a folder that a ``Ledger`` needs.  A view is created only if there
    is none of that name, which the catalog decides for all its users; so the pointer of
    a warehouse works on object stores too.
    """

    def __init__(self, spark: SparkSession, database: str, name: str):
        for part in (database, name):
            if not re.fullmatch(r"[a-z0-9_]+", part) or _SEPARATOR in part:
                raise ValueError(f"{part!r} is no name for the catalog")
        self._spark, self._database, self._name = spark, database, name

    def _view(self, text_name: str) -> str:
        return f"`{self._database}`.`{self._name}{_SEPARATOR}{text_name}`"

    @staticmethod
    def names(spark: SparkSession, database: str) -> list[str]:
        """The names that have texts in a database."""
        views = [row.viewName for row in spark.sql(f"SHOW VIEWS IN `{database}`").collect() if not row.isTemporary]
        return sorted({name.partition(_SEPARATOR)[0] for name in views if _SEPARATOR in name})

    def files(self) -> list[str]:
        views = self._spark.sql(f"SHOW VIEWS IN `{self._database}`").where(~F.col("isTemporary"))
        heads = f"{self._name}{_SEPARATOR}"
        return sorted(row.viewName[len(heads) :] for row in views.collect() if row.viewName.startswith(heads))

    def exists(self, text_name: str) -> bool:
        return text_name in self.files()

    def create_text(self, text_name: str, text: str) -> bool:
        literal = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
        try:
            self._spark.sql(f"CREATE VIEW {self._view(text_name)} AS SELECT '{literal}' AS text")
        except AnalysisException:
            if self.exists(text_name):
                return False
            raise
        return True

    def read_text(self, text_name: str) -> str | None:
        try:
            return self._spark.sql(f"SELECT text FROM {self._view(text_name)}").first().text
        except AnalysisException:
            if self.exists(text_name):
                raise
            return None

    def delete(self, text_name: str) -> None:
        self._spark.sql(f"DROP VIEW IF EXISTS {self._view(text_name)}")
