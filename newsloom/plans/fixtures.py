"""Inputs that Spark derives from ``documents`` for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import tokenise
from newsloom.plans.corpus import documents, raw_columns
from newsloom.schema import LEXICON_SCHEMA, RAW_FIELDS
from newsloom.sources.storage import Folder, join_files, scratch_folder, settled

# --- fixed values: a lexicon of words the documents use ------------------------
LEXICON = (("the", 2), ("of", 1), ("erst", 3), ("in", -2), ("and", -1))
# -------------------------------------------------------------------------------

# About so many bytes of a file that is joined from several are written by one task.
PART_BYTES = 64 * 1024 * 1024


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), LEXICON_SCHEMA)


def article_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id`` and one valid JSON line per document."""
    return documents(spark, folder).select(
        "doc_id", F.to_json(F.struct(*raw_columns())).alias("value")
    )


def short_article_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One valid JSON line per line of text: many short articles, as in news."""
    lines = documents(spark, folder).select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("place", "text")
    )
    return lines.select("doc_id", F.to_json(F.struct(*raw_columns())).alias("value"))


def damaged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One line per document, most of them odd in one of 24 ways.

    The way follows from ``doc_id % 30``; 0 and 25 to 29 are plain, 1 to 4 and 21 to
    24 odd but valid, 5 to 20 invalid.
    """
    rows = documents(spark, folder).select("doc_id", *raw_columns())
    line = F.to_json(F.struct(*RAW_FIELDS))
    open_line = F.regexp_replace(line, r"\}\z", "")
    undated = F.regexp_replace(F.to_json(F.struct(*RAW_FIELDS[:-1])), r"\}\z", "")

    def end(start: Column, tail: str) -> Column:
        return F.concat(start, F.lit(tail))

    ways = {
        1: end(open_line, ',"extra":[[1],{"k":"v"}]}'),
        2: end(line, "\r"),
        3: F.concat(F.lit(" \t"), line),
        4: F.to_json(F.array(*RAW_FIELDS)),
        5: end(undated, "}"),
        6: end(undated, ',"date":null}'),
        7: end(undated, ',"date":20180526}'),
        8: end(undated, ',"date":["2018-05-26"]}'),
        9: end(open_line, ',"date":"2018-05-26"}'),
        10: end(line, " trailing"),
        11: F.concat(line, line),
        12: F.concat(line, F.lit(","), line),
        13: F.translate(line, '"', "'"),
        14: open_line,
        15: F.lit("null"),
        16: F.lit(""),
        17: F.lit("[1,2]"),
        18: end(line, "]"),
        19: end(undated, ',"date":"\\ud800"}'),
        20: F.to_json(F.array(*RAW_FIELDS[:-1])),
        21: end(open_line, ',"extra":{"k":1,"k":[2]}}'),
        22: end(open_line, ',"extra":"\\ud800"}'),
        23: end(open_line, ',"extra":1,"extra":{"date":null}}'),
        24: end(open_line, ',"\\udc00":"}]","extra":"\\\\ud800"}'),
    }
    way = (F.col("doc_id") % 30).cast("int")
    value = line
    for number, text in ways.items():
        value = F.when(way == number, text).otherwise(value)
    return rows.select("doc_id", value.alias("value"))


def dated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One valid JSON line per document, with dates of many forms."""
    rows = documents(spark, folder).select("doc_id", *raw_columns())
    dated = rows.withColumn("date", date_forms(F.col("date"), F.col("doc_id")))
    return dated.select("doc_id", F.to_json(F.struct(*RAW_FIELDS)).alias("value"))


def date_forms(day: Column, doc_id: Column) -> Column:
    """A date string made from ``day``: valid for ``doc_id % 16`` below 10."""
    millis = (F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400000).cast("string")

    def then(tail: str) -> Column:
        return F.concat(day, F.lit(tail))

    forms = [
        day,
        F.substring(day, 1, 7),
        F.substring(day, 1, 4),
        then("T10"),
        then("T10:11"),
        then("T10:11:12.345Z"),
        then("T10:11:12+02:00"),
        then("T10:11:12-0230"),
        then("T10:11:12,5Z"),
        millis,
        F.lit(""),
        F.lit("not a date"),
        F.concat(F.substring(day, 1, 4), F.lit("-13-01")),
        F.substring(day, 3, 8),
        then(" 10:11:12"),
        then("T25"),
    ]
    form = (doc_id % len(forms)).cast("int")
    value = F.lit(None).cast("string")
    for number, text in enumerate(forms):
        value = F.when(form == number, text).otherwise(value)
    return value


def large_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents, with a valence that follows from its length.

    It is made once: a lexicon is read several times.
    """
    tokens = documents(spark, folder).select(F.explode(tokenise(F.col("text"))).alias("word"))
    valence = (F.length("word") % 5 - 2).cast("int")
    return settled(tokens.distinct().select("word", valence.alias("valence")), "lexicon")


def write_lines(lines: DataFrame, label: str) -> str:
    """Write ``value`` as text files to a new scratch folder; returns its path."""
    folder = scratch_folder(lines.sparkSession, label)
    lines.select("value").write.text(folder)
    return folder


def write_file(lines: DataFrame, label: str) -> str:
    """Write ``value`` as one text file, in the order of the ids, to a new scratch folder;
    returns its path.

    Each range of ids is written by a task of its own and copied to its place in the file
    by another.  File systems other than those of the machines themselves have no way to
    write to a place in a file: there, one task writes it all.
    """
    spark, folder = lines.sparkSession, scratch_folder(lines.sparkSession, label)
    if not Folder(spark, folder).is_local():
        lines.orderBy("doc_id").coalesce(1).select("value").write.text(folder)
        return folder
    rows = settled(lines.select("doc_id", "value"), f"{label}-rows")
    n_bytes = rows.agg(F.sum(F.octet_length("value") + F.lit(1).cast("bigint"))).first()[0] or 0
    n_parts = n_bytes // PART_BYTES + 1
    ordered = rows.repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id")
    parts = scratch_folder(spark, f"{label}-parts")
    ordered.select("value").write.text(parts)
    join_files(spark, parts, folder, "part-00000.txt")
    return folder
