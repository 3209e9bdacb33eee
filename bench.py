"""Headline queries, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import fixtures
from newsloom.plans.ask import category_stats, fulltext_search, significant_words
from newsloom.plans.refresh import RefreshOptions, refresh
from newsloom.plans.registry import QUERIES
from newsloom.sources import ndjson
from newsloom.sources.ndjson import first_articles
from newsloom.sources.storage import scratch_folder
from newsloom.sources.warehouse import Warehouse

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
DIRECT = [
    "tokenize",
    "sentiment_enrich",
    "match_any_token",
    "sentiment_stats",
    "sentiment_stats_all",
    "category_stats",
    "category_stats_all",
    "terms_return_flags",
    "match_text_bm25",
    "search_multi_field",
    "significant_words",
    "term_statistics",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(times: dict[str, float], name: str, work) -> None:
    """The better of two runs; the first one also warms the virtual machine up."""
    runs = []
    for _ in range(2):
        started = time.perf_counter()
        work()
        runs.append(time.perf_counter() - started)
    times[name] = round(min(runs), 3)


def dealt(spark: SparkSession, n_files: int) -> str:
    """The tables the direct queries read, in as many files as there are cores.

    The given tables are one small file each, which is one task; a large table is
    many files, and its queries need no shuffle to use all cores."""
    folder = scratch_folder(spark, "bench-tables")
    for name in ("documents", "lineitem"):
        table = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        table.repartition(n_files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    lexicon = fixtures.lexicon(spark)
    # Inputs, not part of a query: long documents, and their lines as short articles.
    source = fixtures.write_lines(fixtures.article_lines(spark, FOLDER), "bench-news")
    tables = dealt(spark, int(CPUS) * 2)
    short = fixtures.write_lines(fixtures.short_article_lines(spark, tables), "bench-short")
    one_file = fixtures.write_lines(fixtures.article_lines(spark, FOLDER).coalesce(1), "bench-one")
    n_docs, n_short = spark.read.text(source).count(), spark.read.text(short).count()

    # The whole ingest: strict scan, first-rows limit, sentiment, write, publish.
    warehouse = Warehouse(spark, scratch_folder(spark, "bench"))
    timed(times, "ingest_short", lambda: refresh(warehouse, lexicon, RefreshOptions(short)))
    timed(times, "ingest", lambda: refresh(warehouse, lexicon, RefreshOptions(source)))
    table = warehouse.published()
    timed(times, "term_tables", lambda: warehouse.write_terms(table))
    timed(times, "search_published", lambda: run(fulltext_search(warehouse, "the erst en")))
    timed(times, "category_stats_published", lambda: run(category_stats(warehouse, "ther")))
    timed(times, "significant_words_published", lambda: run(significant_words(warehouse, "erst")))
    for name in DIRECT:
        timed(times, name, lambda: run(QUERIES[name](spark, tables)))
    # The beginning of one file: a prefix smaller than the file is parsed.
    ndjson._LEAST_BYTES = 1 << 20
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    timed(times, "first_rows_of_one_file", lambda: run(first_articles(spark, one_file, 500)))
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time, better of two runs each",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": FOLDER.rstrip("/").rpartition("sf")[2],
                "documents": n_docs,
                "ingest_docs_per_sec": round(n_docs / times["ingest"]),
                "short_articles": n_short,
                "ingest_short_docs_per_sec": round(n_short / times["ingest_short"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
