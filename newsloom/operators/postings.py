"""Term statistics of text columns (AG7) and the tables that hold them.

``postings``  field, bucket, term, doc_id, tf, length, is_first
``term_df``   field, bucket, term, df
``peaks``     field, bucket, term, id_range, n, max_tf, least_ratio
``corpus``    field, n_docs, n_tokens, n_buckets
``row_terms`` field, doc_id, terms, tfs, length

``bucket`` is a hash of the term and a directory level, so that a query reads
only the directories of its own terms; within a file, terms are sorted, so that
row groups without them are skipped.  ``row_terms`` has the distinct terms of
each row, in the order of the rows, so that files and row groups are ranges of ids.
``peaks`` bounds what the rows of one range of ids can score for a frequent term.
Above these levels is ``part``: the table as it was written, or one folder appended
to it; counts add up over the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.scores import stored_length
from newsloom.functions.text import tokenise
from newsloom.operators import batches
from newsloom.schema import TEXT_FIELDS
from newsloom.session import ship
from newsloom.sources.storage import Folder, shuffles_dropped

POSTINGS, TERM_DF, PEAKS, CORPUS, ROW_TERMS = "postings", "term_df", "peaks", "corpus", "row_terms"
BASE_PART = "base"
# Directories per field: few for a small table, and for a large one enough that
# a query term's directory is a small part of it.
LEAST_BUCKETS, MOST_BUCKETS, BYTES_PER_BUCKET = 8, 4096, 256 * 1024 * 1024
# A term in so many rows of a part has peaks, one record for each range of 2 ** RANGE_BITS
# ids that holds it.
FREQUENT_ROWS, RANGE_BITS = 1 << 16, 12
# Ranges of ids that a filter names; more are taken together.
MOST_RANGES = 256
# A merge shuffles one range of ids after the other, so that what is shuffled takes a part of
# the disk the whole would: a range for so many bytes of row_terms, and so many at most.
SLICE_BYTES, MOST_SLICES = 32 * 1024 * 1024, 8


def grouped_terms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, entries, length``: the distinct tokens of each row with their number.

    See ``terms_of_rows``, whose two arrays are one here.
    """
    rows = terms_of_rows(df, keys, text)
    entries = F.transform(
        F.arrays_zip("terms", "tfs"),
        lambda entry: F.struct(entry["terms"].alias("term"), entry["tfs"].alias("tf")),
    )
    return rows.select(*keys, entries.alias("entries"), "length")


def terms_of_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, terms, tfs, length``: the distinct tokens of each row, in order, and the
    number of each.

    Sorting the tokens of a row puts equal ones next to each other; the ends of their runs
    tell the numbers.  All of it happens inside the row, so nothing is shuffled.
    """
    ordered = df.select(*keys, F.sort_array(tokenise(F.col(text))).alias("tokens"))
    # Lambdas are interpreted for every token: as little as possible in them.
    ends = F.filter(
        F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.get("tokens", i).isNull() | (F.get("tokens", i) != F.get("tokens", i - 1)),
    )
    runs = ordered.select(*keys, "tokens", ends.alias("ends"))
    tfs = F.transform("ends", lambda end, i: end - F.coalesce(F.get("ends", i - 1), F.lit(0)))
    terms = F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>"))
    return runs.select(*keys, terms.alias("terms"), tfs.alias("tfs"), F.size("tokens").alias("length"))


def term_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, term, tf, length, is_first``: the distinct tokens of each row.

    ``is_first`` marks one record per row, which makes rows countable.
    """
    rows = grouped_terms(df, keys, text)
    entries = F.transform(
        "entries",
        lambda entry, i: F.struct(
            entry["term"].alias("term"),
            entry["tf"].alias("tf"),
            F.col("length").alias("length"),
            (i == 0).alias("is_first"),
        ),
    )
    return rows.select(*keys, F.inline(entries))


def _by_field(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return df.select("doc_id", F.inline(texts))


def postings(df: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Term counts of several text columns of one table, in one pass over it."""
    return term_counts(_by_field(df, fields), ["field", "doc_id"], "text")


def document_frequencies(entries: DataFrame, *keys: str) -> DataFrame:
    """Rows holding each term; counted per task before the shuffle."""
    return entries.groupBy(*keys, "term").agg(F.count("*").alias("df"))


def corpus_statistics(entries: DataFrame) -> DataFrame:
    """Per field: rows with at least one token, and tokens in all."""
    return entries.groupBy("field").agg(
        F.count_if("is_first").alias("n_docs"), F.sum("tf").alias("n_tokens")
    )


def buckets_for(n_bytes: int) -> int:
    """Number of buckets for a table of that size."""
    return min(max(n_bytes // BYTES_PER_BUCKET, LEAST_BUCKETS), MOST_BUCKETS)


def bucket_of(term: Column, n_buckets: int | Column) -> Column:
    size = n_buckets if isinstance(n_buckets, Column) else F.lit(n_buckets)
    return F.pmod(F.xxhash64(term), size).cast("int")


def id_range(doc_id: Column) -> Column:
    return F.shiftright(doc_id, RANGE_BITS)


def peaks(entries: DataFrame, *keys: str) -> DataFrame:
    """Per term and range of ids: rows, and what bounds the score of each of them.

    A term's share in a score rises with tf and falls with length / tf, whatever the mean
    length is; the best of both over the rows of a range bounds them all.
    """
    return entries.groupBy(*keys, "term", id_range(F.col("doc_id")).alias("id_range")).agg(
        F.count("*").alias("n"),
        F.max("tf").alias("max_tf"),
        F.min(stored_length(F.col("length")) / F.col("tf")).alias("least_ratio"),
    )


def write_term_tables(
    articles: DataFrame,
    folder: str,
    fields: tuple[str, ...] = TEXT_FIELDS,
    n_buckets: int = LEAST_BUCKETS,
    part: str = BASE_PART,
) -> None:
    """Write the tables of ``articles`` below ``folder``, as one part of them.

    Text is segmented once, in a narrow pass that writes the terms of each row; the other
    tables are derived from what is written.
    """
    spark = articles.sparkSession
    ship(spark)
    target = TermTables(spark, folder, (part,))
    tokens = _by_field(articles, fields).select("field", "doc_id", tokenise(F.col("text")).alias("tokens"))
    with shuffles_dropped(spark):
        target.writer(tokens.mapInArrow(batches.counted, batches.COUNTED), "field").parquet(target.place(ROW_TERMS))
        written = target.read(ROW_TERMS)
        _write_postings(target, n_buckets)
        corpus = written.groupBy("field").agg(
            F.count_if(F.col("length") > 0).alias("n_docs"),
            F.sum(F.col("length").cast("bigint")).alias("n_tokens"),
        )
        _write_corpus(target, corpus, n_buckets)


def merge_term_tables(
    parts: TermTables, merged: str, on_written: Callable[[tuple[str, ...]], None] | None = None
) -> None:
    """Write the term tables of several parts as one part, without any text.

    ``row_terms`` are written first, and what is derived from them then, one range of ids after
    the other.  ``on_written`` is told which tables are complete: those of the parts are not
    read any more."""
    target = TermTables(parts.spark, parts.folder, (merged,))
    with shuffles_dropped(parts.spark):
        rows = parts.read(ROW_TERMS)
        slices = slices_of_ids(rows, min(-(-parts.size(ROW_TERMS) // SLICE_BYTES), MOST_SLICES))
        for k, within in enumerate(slices):
            ordered = rows.where(within).repartitionByRange("field", "doc_id").sortWithinPartitions("field", "doc_id")
            target.writer(ordered, "field").mode(_mode(k)).parquet(target.place(ROW_TERMS))
        if on_written is not None:
            on_written((ROW_TERMS,))
        bucket = bucket_of(F.col("term"), parts.n_buckets).alias("bucket")
        frequencies = parts.read(TERM_DF).groupBy("field", bucket, "term").agg(F.sum("df").alias("df"))
        _write_postings(target, parts.n_buckets, slices, frequencies)
        _write_corpus(target, parts.corpus.drop("n_buckets"), parts.n_buckets)
    if on_written is not None:
        on_written((POSTINGS, TERM_DF, PEAKS, CORPUS))


def slices_of_ids(rows: DataFrame, n: int) -> list[Column]:
    """Conditions that deal ``rows`` into ``n`` ranges of ids (fewer, if ids repeat) with about
    as many rows each; those without an id are in the first."""
    if n < 2:
        return [F.lit(True)]
    doc_id, shares = F.col("doc_id"), [k / n for k in range(1, n)]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", shares)).first()[0] or []))
    if not cuts:
        return [F.lit(True)]
    between = [(doc_id > low) & (doc_id <= high) for low, high in zip(cuts, cuts[1:], strict=False)]
    return [doc_id.isNull() | (doc_id <= cuts[0]), *between, doc_id > cuts[-1]]


def _mode(k: int) -> str:
    """How the ``k``-th slice of a table is written: beside the others."""
    return "append" if k else "overwrite"


def _write_postings(
    target: TermTables,
    n_buckets: int,
    slices: Iterable[Column] | None = None,
    frequencies: DataFrame | None = None,
) -> None:
    """Postings are dealt and sorted in blocks, those of one term in neighbouring rows; taken
    apart, they are in order but for blocks of the same ids, and sorting them takes little.

    The rebalance groups equal buckets and lets adaptive execution split those a
    frequent term makes large.  Each of ``slices`` is dealt and written by itself.
    ``frequencies`` are the records of ``term_df`` if they are known."""
    ship(target.spark)
    rows = target.read(ROW_TERMS).select("field", "doc_id", "terms", "tfs", "length")
    for k, within in enumerate(slices or [F.lit(True)]):
        blocks = rows.where(within).mapInArrow(batches.blocks, batches.BLOCKS)
        dealt = (
            blocks.withColumn("bucket", bucket_of(F.col("term"), n_buckets))
            .hint("rebalance", "field", "bucket")
            .sortWithinPartitions("field", "bucket", "term", "least")
        )
        entries = dealt.mapInArrow(batches.records, batches.RECORDS)
        target.writer(
            entries.sortWithinPartitions("field", "bucket", "term", "doc_id"), "field", "bucket"
        ).mode(_mode(k)).parquet(target.place(POSTINGS))
    written = target.read(POSTINGS)
    if frequencies is None:
        frequencies = document_frequencies(written, "field", "bucket")
    target.writer(
        frequencies.hint("rebalance", "field", "bucket")
        .sortWithinPartitions("field", "bucket", "term"),
        "field", "bucket",
    ).parquet(target.place(TERM_DF))
    frequent = target.read(TERM_DF).where(F.col("df") >= FREQUENT_ROWS).drop("df")
    if frequent.isEmpty():
        return
    # One record for FREQUENT_ROWS postings at most: sent to the tasks, so that these are
    # not shuffled but counted where they are read.
    kept = written.join(F.broadcast(frequent), ["field", "bucket", "term"], "left_semi")
    target.writer(
        peaks(kept, "field", "bucket")
        .hint("rebalance", "field", "bucket")
        .sortWithinPartitions("field", "bucket", "term", "id_range"),
        "field", "bucket",
    ).parquet(target.place(PEAKS))


def _write_corpus(target: TermTables, corpus: DataFrame, n_buckets: int) -> None:
    # One row per field.
    rows = corpus.withColumn("n_buckets", F.lit(n_buckets)).coalesce(1)
    target.writer(rows).parquet(target.place(CORPUS))


# --- fixed values: schemas of the written tables ---------------------------------
_SCHEMAS = {
    POSTINGS: "term string, doc_id bigint, tf int, length int, is_first boolean, field string, bucket int",
    TERM_DF: "term string, df bigint, field string, bucket int",
    PEAKS: "term string, id_range bigint, n bigint, max_tf int, least_ratio double, field string, bucket int",
    CORPUS: "field string, n_docs bigint, n_tokens bigint, n_buckets int",
    ROW_TERMS: "doc_id bigint, terms array<string>, tfs array<int>, length int, field string",
}
# ---------------------------------------------------------------------------------

# How files are written: terms are in order, and ids and numbers small steps from row to row.
_STORED = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#terms.list.element": "false",
}


@dataclass(frozen=True)
class TermTables:
    """The term tables below a folder: those of some parts, or of all that are there.

    Records of ``term_df`` and ``corpus`` are there for each part, and are to be added up.
    ``standing`` names, for a part whose tables are not all written, the parts it was merged
    from, by table: they hold the same records.
    """

    spark: SparkSession
    folder: str
    parts: tuple[str, ...] | None = None
    standing: Mapping[str, Mapping[str, list[str]]] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, tables: TermTables | str) -> TermTables:
        return cls(spark, tables) if isinstance(tables, str) else tables

    def place(self, table: str) -> str:
        (part,) = self.parts
        return f"{self.folder}/{table}/part={part}"

    @staticmethod
    def writer(rows: DataFrame, *directories: str):
        return rows.write.mode("overwrite").partitionBy(*directories).options(**_STORED)

    def delete(self, kept: Iterable[str] = ()) -> None:
        """Delete the tables of one part but for those ``kept``."""
        for table in set(_SCHEMAS).difference(kept):
            Folder(self.spark, self.place(table)).delete("")

    def sources(self) -> dict[str, list[str]]:
        """By table, the parts it is read from."""
        found = {}
        for table in _SCHEMAS:
            places = [self.standing.get(part, {}).get(table, [part]) for part in self.parts]
            found[table] = [*dict.fromkeys(part for several in places for part in several)]
        return found

    def size(self, table: str) -> int:
        """Bytes of a table."""
        return sum(Folder(self.spark, path).size("") for path in self._paths(table))

    def _paths(self, table: str) -> list[str]:
        if self.parts is None:
            return [f"{self.folder}/{table}"]
        return [f"{self.folder}/{table}/part={part}" for part in self.sources()[table]]

    def read(self, table: str) -> DataFrame:
        """The records, with their ``part`` if several may be read."""
        paths = self._paths(table)
        if table == PEAKS:  # only written for parts with frequent terms
            paths = [path for path in paths if Folder(self.spark, path).exists("")]
            if not paths:
                return self.spark.createDataFrame([], f"{_SCHEMAS[table]}, part string")
        reader = self.spark.read.schema(f"{_SCHEMAS[table]}, part string")
        return reader.option("basePath", f"{self.folder}/{table}").parquet(*paths)

    @cached_property
    def corpus(self) -> DataFrame:
        """One record per field, over all parts."""
        return self.read(CORPUS).groupBy("field").agg(
            F.sum("n_docs").alias("n_docs"),
            F.sum("n_tokens").alias("n_tokens"),
            F.max("n_buckets").alias("n_buckets"),
        )

    @cached_property
    def n_buckets(self) -> int:
        return self.read(CORPUS).agg(F.max("n_buckets")).first()[0] or LEAST_BUCKETS

    def entries(self, table: str, fields: list[str], terms: list[str]) -> DataFrame:
        """Records of some terms; only their directories and row groups are read."""
        buckets = [bucket_of(F.lit(term), self.n_buckets) for term in terms]
        return self.read(table).where(
            F.col("field").isin(fields) & F.col("bucket").isin(*buckets) & F.col("term").isin(terms)
        )

    def matching_ids(self, field: str, terms: list[str]) -> DataFrame:
        """``doc_id`` of the rows holding any of ``terms``, without reading their text."""
        found = self.entries(POSTINGS, [field], terms).select("doc_id")
        return found if len(terms) == 1 else found.distinct()


def read_term_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The records of all parts; those of ``term_df`` and ``corpus`` are to be added up."""
    return TermTables(spark, folder).read(table).drop("part")


def in_ranges(doc_id: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether an id lies in one of some ranges (both ends included), as comparisons that
    reach the scan; neighbours are taken together until there are ``MOST_RANGES``."""
    joined: list[list[int]] = []
    for low, high in sorted(ranges):
        if joined and low <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    if len(joined) > MOST_RANGES:  # close the narrowest gaps
        gaps = sorted(range(1, len(joined)), key=lambda k: joined[k][0] - joined[k - 1][1])
        closed = set(gaps[: len(joined) - MOST_RANGES])
        wider: list[list[int]] = []
        for k, (low, high) in enumerate(joined):
            if k in closed:
                wider[-1][1] = high
            else:
                wider.append([low, high])
        joined = wider

    def any_of(low: int, high: int) -> Column:  # a balanced tree: deep ones are slow to plan
        if high - low == 1:
            return doc_id.between(*joined[low])
        middle = (low + high) // 2
        return any_of(low, middle) | any_of(middle, high)

    return any_of(0, len(joined)) if joined else F.lit(False)


def ranges_of(ids: DataFrame, most: int = 4 * MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all of ``ids``, as narrow as they can be told apart."""
    ends = ids.groupBy(id_range(F.col("doc_id")).alias("at")).agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    return few_ranges(ends, most)


def few_ranges(ends: DataFrame, most: int = 4 * MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges (low, high) that hold those of ``ends``, which are numbered
    by ``at``: neighbours are taken together, the more the more there are."""
    while True:
        found = ends.limit(most + 1).collect()
        if len(found) <= most:
            return [(row.low, row.high) for row in found]
        ends = ends.groupBy(F.shiftright("at", 4).alias("at")).agg(
            F.min("low").alias("low"), F.max("high").alias("high")
        )
