"""Full refresh: read, score, write a new version, publish it (SK3, SK5, SK6)."""

from __future__ import annotations

import time
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_date
from newsloom.operators.sentiment import enrich
from newsloom.schema import ARTICLE_SCHEMA
from newsloom.sources.ndjson import first_articles_cut, parse_lines, scan_lines
from newsloom.sources.storage import Folder, scratch_folder
from newsloom.sources.warehouse import RETAIN_MS, Warehouse

@dataclass(frozen=True)
class RefreshOptions:
    """What to read, and how to write it.

    ``max_news=None`` reads everything, in one narrow pass; a number reads that many
    articles from the beginning.  ``n_partitions`` and ``rows_per_file`` set the
    number of files (a multiple of it for a table whose files would be large) and bound
    their rows; by default both follow from the splits of the source.  The superseded version stays for ``retain_ms``, for the queries that read it,
    and for ever with ``leave_old``.
    """

    source: str
    max_news: int | None = None
    n_partitions: int | None = None
    rows_per_file: int | None = None
    leave_old: bool = False
    term_tables: bool = False
    retain_ms: int = RETAIN_MS


@dataclass(frozen=True)
class RefreshSummary:
    """``total_indexed`` counts the articles sent; some of them may be rejected.

    ``dropped`` counts the lines that are no articles (not known if ``max_news`` was
    given: the lines are not all read), ``limit_cut`` says that ``max_news`` left
    articles out.
    """

    total_indexed: int
    accepted: int
    rejected: int
    new_index_name: str
    elapsed_ms: int
    dropped: int | None
    limit_cut: bool

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [astuple(self)],
            "total_indexed bigint, accepted bigint, rejected bigint, new_index_name string, "
            "elapsed_ms bigint, dropped bigint, limit_cut boolean",
        )


def with_moment(articles: DataFrame) -> DataFrame:
    """Add ``date_ts``; NULL marks an article the date column refuses."""
    return articles.withColumn("date_ts", parse_date(F.col("date")))


def split_by_date(articles: DataFrame) -> DataFrame:
    """Articles with ``date_ts`` and ``accepted``; one pass, whatever is done with either side."""
    return with_moment(articles).withColumn("accepted", F.col("date_ts").isNotNull())


def publishable(articles: DataFrame, lexicon: DataFrame, rejected: Observation | None = None) -> DataFrame:
    """Accepted articles with sentiment, in the stored schema; one narrow plan."""
    dated = with_moment(articles)
    if rejected is not None:
        dated = dated.observe(rejected, F.count_if(F.col("date_ts").isNull()).alias("rejected"))
    accepted = dated.where(F.col("date_ts").isNotNull())
    return enrich(accepted, lexicon).select(*ARTICLE_SCHEMA.fieldNames())


def refresh(
    warehouse: Warehouse, lexicon: DataFrame, options: RefreshOptions
) -> RefreshSummary:
    """Build the next version from ``options.source`` and publish it.

    A failed run leaves nothing under the name of a version, and a version that is
    kept is never written again: the new one has the first name above them all, which no
    other run under way has.  Readers change over only when the new version is complete.
    Superseded versions are deleted by the first run after ``retain_ms``, so that queries
    built before still find their files.  Of runs that overlap, the first to publish does;
    the others fail and remove what they have written.
    """
    started = time.monotonic()
    spark, scratch, limit_cut = warehouse.spark, None, False
    # A plan known to be empty is never executed and observes nothing.
    observed = None if options.max_news is not None and options.max_news <= 0 else Observation()
    lines = None
    if options.max_news is None:
        lines = Observation()
        source = scan_lines(spark, options.source).observe(lines, F.count("*").alias("lines"))
        articles = parse_lines(source)
    else:
        scratch = scratch_folder(spark, "first-rows")
        articles, limit_cut = first_articles_cut(spark, options.source, options.max_news, scratch)
    seen, new = warehouse.pointer(), warehouse.claim_next()
    done = False
    try:
        rows = publishable(articles, lexicon, observed)
        warehouse.drop_terms(new)
        warehouse.write(rows, new, options.n_partitions, options.rows_per_file)
        if scratch is not None:
            Folder(spark, scratch).delete("")
        accepted = warehouse.read(new).count()  # from the file footers
        if options.term_tables:
            warehouse.write_terms(new)
        done = warehouse.publish_after(seen, new)
        if not done:
            raise ValueError(f"the published table has moved from {seen.table!r} to {warehouse.published()!r}")
    finally:
        if not done and warehouse.published() != new:
            warehouse.drop(new)
        warehouse.release(new)
    if seen.table is not None and not options.leave_old:
        warehouse.retire(seen.table)
    warehouse.sweep(options.retain_ms)
    refused = 0 if observed is None else observed.get["rejected"]
    dropped = None if lines is None else lines.get["lines"] - accepted - refused
    elapsed = int((time.monotonic() - started) * 1000)
    return RefreshSummary(accepted + refused, accepted, refused, new, elapsed, dropped, limit_cut)
