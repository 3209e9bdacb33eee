"""Strict newline-delimited JSON scan (SC1, SC2) and its first rows (SL4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.schema import RAW_FIELDS
from newsloom.sources.storage import scratch_folder

# --- fixed values: line grammar ------------------------------------------------
JSON_SPACE = r"[ \t\r\n]*"
# A value that closes early, so that the wrapping bracket may close early too.
EARLY_END = rf"[}}\]]{JSON_SPACE}\]"
# An escaped UTF-16 surrogate without its partner is not a character: skip plain
# text, escapes of anything else and whole pairs; a \u that is left is alone.
LONE_SURROGATE = (
    r"(?s)^(?:[^\\]++|\\[^u]|\\u(?![dD][89a-fA-F])"
    r"|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F])*+\\u"
)
# The same up to the first lone surrogate, which is the rest of the match.
UP_TO_LONE = (
    r"(?s)((?:[^\\]++|\\[^u]|\\u(?![dD][89a-fA-F])"
    r"|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})*+)\\u[dD][89a-fA-F][0-9a-fA-F]{2}"
)
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# -------------------------------------------------------------------------------

# Sizing of the file prefix read for the first n rows; any value gives the same rows.
_BYTES_PER_ROW, _LEAST_BYTES, _GROWTH = 1024, 64 * 1024 * 1024, 4


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines ended by ``\\n`` alone; a carriage return does not end a line."""
    return spark.read.option("lineSep", "\n").text(paths)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Keep the lines that hold exactly one article of six strings.

    An article is an object with the six fields or an array of six strings in field
    order.  Other fields are ignored, whatever valid JSON they hold.  Every other line
    is dropped: a field of the six missing, repeated, null or no string, trailing
    text, bad UTF-8, not JSON.  Each kept row gets a ``doc_id``, unique and ascending
    within a file block.
    """
    places = [name for name in lines.columns if name != "value"]
    keys = ["doc_id", *places]
    value = F.col("value")
    is_object = value.rlike(rf"^{JSON_SPACE}\{{")
    # The running id also keeps filters from being pushed below this projection,
    # where each of them would parse the line again.
    wrapped = lines.select(
        F.monotonically_increasing_id().alias("doc_id"),
        *places,
        "value",
        F.when(
            F.is_valid_utf8("value") & value.rlike(rf"^{JSON_SPACE}[\[{{]"),
            F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))),
        ).alias("wrapped"),
        # A search for two characters first: the expression reads every line to its end.
        (value.contains("\\u") & value.rlike(LONE_SURROGATE)).alias("lone"),
    )
    single = (
        F.try_variant_get("wrapped", "$[1]", "variant").isNull()
        & ~F.col("lone")
        & (
            ~(value.contains("]") & value.rlike(EARLY_END))
            | F.try_parse_json(F.concat(F.lit('{"line":'), "value", F.lit("}"))).isNotNull()
        )
    )
    # A variant holds no object with a repeated key, nor a very long line; such lines,
    # and those with a lone surrogate somewhere, are few and read once more by field.
    odd = (F.col("wrapped").isNull() | F.col("lone")) & is_object & F.is_valid_utf8("value")
    object_type = "struct<" + ",".join(f"{name}:variant" for name in RAW_FIELDS) + ">"
    checked = wrapped.select(
        *keys,
        is_object.alias("is_object"),
        F.when(single, F.col("wrapped")).alias("whole"),
        F.when(odd, _by_field(value, object_type)).alias("again"),
    )
    shaped = checked.select(
        *keys,
        F.when(F.col("is_object"), F.try_variant_get("whole", "$[0]", object_type)).alias("members"),
        F.when(~F.col("is_object"), F.try_variant_get("whole", "$[0]", "array<variant>")).alias("items"),
        "again",
    )
    complete = F.size("items") == len(RAW_FIELDS)
    fields = F.struct(
        *[
            F.coalesce(
                F.col("members")[name], F.col("again")[name], F.when(complete, F.get("items", F.lit(i)))
            ).alias(name)
            for i, name in enumerate(RAW_FIELDS)
        ]
    )
    # Filters on generated columns stay above the generator for the same reason.
    rows = shaped.select(*keys, F.inline(F.array(fields)))
    all_strings = F.lit(True)
    for name in RAW_FIELDS:
        all_strings = all_strings & (F.schema_of_variant(name) == "STRING")
    return rows.where(all_strings).select(
        *keys, *[F.try_variant_get(name, "$", "string").alias(name) for name in RAW_FIELDS]
    )


def _by_field(value: Column, object_type: str) -> Column:
    """The six members of a line that is one object, reading past all others; NULL unless
    each is there once and none holds a lone surrogate."""

    def parsed(text: Column) -> Column:
        return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{object_type}>", STRICT_JSON)

    def strings(members: Column) -> Column:
        return F.array(*[F.try_variant_get(members[name], "$", "string") for name in RAW_FIELDS])

    found = parsed(value)
    named = F.filter(F.json_object_keys(value), lambda name: name.isin(list(RAW_FIELDS)))
    line = F.from_json(
        F.concat(F.lit('{"line":'), value, F.lit("}")), f"line {object_type}", STRICT_JSON
    )
    # With another character in its place, a lone surrogate in a field changes the field.
    replaced = parsed(F.regexp_replace(value, UP_TO_LONE, r"$1\\uFFFD"))
    whole = (
        (F.size(found) == 1)
        & (F.size(named) == len(RAW_FIELDS))
        & (F.size(F.array_distinct(named)) == len(RAW_FIELDS))
        & (~value.rlike(EARLY_END) | line["line"].isNotNull())
        & (~value.rlike(LONE_SURROGATE) | (strings(F.get(found, F.lit(0))) == strings(F.get(replaced, F.lit(0)))))
    )
    return F.when(whole, F.get(found, F.lit(0)))


def read_articles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``doc_id`` and the six fields of every valid line; a narrow, lazy plan."""
    return parse_lines(scan_lines(spark, paths))


def _articles_in_place(lines: DataFrame) -> DataFrame:
    """The same rows with the file and block each was read from."""
    return parse_lines(
        lines.select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )


def first_articles(spark: SparkSession, path: str, n: int, folder: str | None = None) -> DataFrame:
    """The first ``n`` valid articles in file order (files by path)."""
    return first_articles_cut(spark, path, n, folder)[0]


def first_articles_cut(
    spark: SparkSession, path: str, n: int, folder: str | None = None
) -> tuple[DataFrame, bool]:
    """The first ``n`` valid articles, and whether there are more.

    Parses a prefix of the bytes, grown until it holds more than ``n`` articles,
    instead of sorting the whole input: of the one file the prefix ends in, only
    the blocks before its end are parsed.  The prefix is written once, so that its
    block boundaries are settled; blocks that fit are kept whole and only the one
    block the limit falls into is ordered by line.  It is written below ``folder``,
    by default a new scratch folder, which the result reads.
    """
    if n <= 0:
        rows = read_articles(spark, path)
        return rows.limit(0), not rows.isEmpty()
    folder = folder or scratch_folder(spark, "first-rows")
    sizes = spark.read.format("binaryFile").load(path).select(
        "path", "length", F.col("_metadata.file_path").alias("file")
    )
    # One row per file: a listing, its content column is never read.
    before = F.sum("length").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    places = sizes.select("path", "file", F.coalesce(before, F.lit(0)).alias("before"))
    n_bytes, budget = sizes.agg(F.sum("length")).first()[0] or 0, max(_LEAST_BYTES, n * _BYTES_PER_ROW)
    while True:
        whole = budget >= n_bytes
        lines = scan_lines(spark, path)
        if not whole:
            # The files that begin before the end of the prefix: at most as many as there
            # are bytes of it, and the place in the last one of them where it ends.
            head = places.where(F.col("before") < budget).orderBy("before").collect()
            last = head[-1]
            lines = scan_lines(spark, [row.path for row in head])
            start = F.col("_metadata.file_block_start")
            lines = lines.where(
                (F.col("_metadata.file_path") != last.file) | (start < budget - last.before)
            )
        settled = _settle(_articles_in_place(lines), folder)
        found = settled.count()
        if whole or found > n:
            return _cut(settled, n), found > n
        budget *= _GROWTH


def _settle(articles: DataFrame, folder: str) -> DataFrame:
    articles.write.mode("overwrite").parquet(folder)
    return articles.sparkSession.read.parquet(folder)


def _cut(articles: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows by (file, block_start, doc_id), whole blocks first."""
    blocks = articles.groupBy("file", "block_start").agg(F.count("*").alias("rows"))
    # One row per file block: block metadata, not data.
    upto = F.sum("rows").over(W.orderBy("file", "block_start"))
    before = blocks.select("file", "block_start", (upto - F.col("rows")).alias("before"))
    last = before.where(F.col("before") < n).orderBy(F.desc("before")).first()
    if last is None:  # no rows
        return articles.drop("file", "block_start")
    same_file = F.col("file") == last.file
    earlier = (F.col("file") < last.file) | (same_file & (F.col("block_start") < last.block_start))
    in_last = same_file & (F.col("block_start") == last.block_start)
    tail = articles.where(in_last).orderBy("doc_id").limit(n - last.before)
    return articles.where(earlier).unionByName(tail).drop("file", "block_start")
