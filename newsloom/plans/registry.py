"""Every query of the engine over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_date
from newsloom.functions.names import version_of
from newsloom.functions.text import tokenise
from newsloom.operators import postings as term_tables
from newsloom.operators.match import match
from newsloom.operators.search import search, search_published
from newsloom.operators.sentiment import enrich, totals_by_join
from newsloom.operators.significant import (
    foreground_background,
    significant_words,
    significant_words_from_terms,
)
from newsloom.operators.terms import category_stats, sentiment_stats, terms_remainder, top_terms
from newsloom.plans import ask, fixtures
from newsloom.plans.corpus import articles_from_documents, documents
from newsloom.plans.refresh import RefreshOptions, refresh, split_by_date
from newsloom.plans.snapshot import restore_snapshot, take_snapshot
from newsloom.schema import RAW_FIELDS
from newsloom.sources.ndjson import first_articles, read_articles
from newsloom.sources.storage import Folder, scratch_folder
from newsloom.sources.warehouse import ALIAS, Warehouse
from newsloom.streaming.refresh import follow_files, refresh_periodically

Query = Callable[[SparkSession, str], DataFrame]

# Words the documents use, and how many rows the first-rows query takes.
WORD, WORDS, THREE_WORDS, FIRST_ROWS = "erst", "erst ther", "the erst en", 250
SUMMARY = ["total_indexed", "accepted", "rejected", "new_index_name", "dropped", "limit_cut"]


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return articles_from_documents(documents(spark, sf))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich(_articles(spark, sf), fixtures.lexicon(spark))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _warehouse(spark: SparkSession) -> Warehouse:
    return Warehouse(spark, scratch_folder(spark, "warehouse"))


def _published(spark: SparkSession, sf: str, lines=fixtures.article_lines, **options) -> Warehouse:
    """A warehouse after one refresh from lines derived from the documents."""
    warehouse = _warehouse(spark)
    source = fixtures.write_lines(lines(spark, sf), "news")
    refresh(warehouse, fixtures.lexicon(spark), RefreshOptions(source, max_news=None, **options))
    Folder(spark, source).delete("")  # the lines are in the table
    return warehouse


# -- scan and ingest --------------------------------------------------------------


def ndjson_scan_strict(spark: SparkSession, sf: str) -> DataFrame:
    source = fixtures.write_lines(fixtures.damaged_lines(spark, sf), "damaged")
    return read_articles(spark, source).select(*RAW_FIELDS)


def first_n_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = fixtures.damaged_lines(spark, sf).orderBy("doc_id")
    source = fixtures.write_lines(lines, "ordered")
    return first_articles(spark, source, FIRST_ROWS).select("link", "headline", "date")


def first_n_rows_one_file(spark: SparkSession, sf: str) -> DataFrame:
    source = fixtures.write_file(fixtures.damaged_lines(spark, sf), "one-file")
    return first_articles(spark, source, FIRST_ROWS).select("link", "headline", "date")


def date_conformance(spark: SparkSession, sf: str) -> DataFrame:
    docs = _articles(spark, sf)
    text = fixtures.date_forms(F.col("date"), F.col("doc_id"))
    dated = docs.select("doc_id", text.alias("date"))
    moment = parse_date(F.col("date"))
    shown = F.coalesce(moment.cast("string"), F.lit("refused"))
    return dated.select("doc_id", "date", moment.isNotNull().alias("accepted"), shown.alias("moment"))


def rejected_articles(spark: SparkSession, sf: str) -> DataFrame:
    source = fixtures.write_lines(fixtures.dated_lines(spark, sf), "dated")
    outcome = F.when(F.col("accepted"), "accepted").otherwise("rejected")
    return split_by_date(read_articles(spark, source)).select("link", outcome.alias("outcome"))


# -- text, sentiment ----------------------------------------------------------------


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    tokens = documents(spark, sf).select("doc_id", tokenise(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


def sentiment_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select(
        "doc_id",
        *RAW_FIELDS,
        F.col("sentiment_score").cast("double").alias("sentiment_score"),
        "sentiment_polarity",
    )


def sentiment_totals_large_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    totals = totals_by_join(_articles(spark, sf), fixtures.lexicon(spark), "short_description")
    return totals.select("doc_id", "positive", "negative")


def sentiment_large_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """With every word of the documents in the lexicon: tens of thousands."""
    enriched = enrich(_articles(spark, sf), fixtures.large_lexicon(spark, sf))
    return enriched.select(
        "doc_id", F.col("sentiment_score").cast("double").alias("sentiment_score"), "sentiment_polarity"
    )


# -- filters ------------------------------------------------------------------------


def match_any_token(spark: SparkSession, sf: str) -> DataFrame:
    return match(_articles(spark, sf), WORDS).select("doc_id")


def _matching(query: str | None, field: str) -> Query:
    return lambda spark, sf: match(_articles(spark, sf), query, field).select("doc_id")


def _at_times(spark: SparkSession, sf: str) -> DataFrame:
    """Articles at the hours and minutes that follow from their ids."""
    hours = F.make_dt_interval(hours=F.pmod(F.col("doc_id"), F.lit(7)).cast("int"), mins=F.pmod(F.col("doc_id"), F.lit(50)).cast("int"))
    return _articles(spark, sf).withColumn("date_ts", F.col("date_ts") + hours)


def match_date_hour(spark: SparkSession, sf: str) -> DataFrame:
    return match(_at_times(spark, sf), "2018-05-26T05", "date").select("doc_id")


def match_date_minute(spark: SparkSession, sf: str) -> DataFrame:
    return match(_at_times(spark, sf), "2018-02-03T05:33Z", "date").select("doc_id")


def match_polarity(spark: SparkSession, sf: str) -> DataFrame:
    return match(_enriched(spark, sf), "Negative", "sentiment_polarity").select("doc_id")


# -- counts -------------------------------------------------------------------------


def terms_with_other(spark: SparkSession, sf: str) -> DataFrame:
    return terms_remainder(_articles(spark, sf), "category")


def terms_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = _table(spark, sf, "labels")
    verdict = F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return top_terms(labels.select(verdict.alias("verdict")), "verdict")


def order_priorities_in_month(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"o_orderdate": "date", "o_orderpriority": "keyword"}
    orders = match(_table(spark, sf, "orders"), "1995-03", "o_orderdate", fields)
    return top_terms(orders, "o_orderpriority")


def event_types_of_day(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"ts": "date", "event_type": "keyword"}
    return top_terms(match(_table(spark, sf, "events"), "2024-01-02", "ts", fields), "event_type")


def roles_mentioning(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"text": "text", "role": "keyword"}
    return top_terms(match(_table(spark, sf, "conversations"), "the", "text", fields), "role")


# -- ranked search, significant words -------------------------------------------------


def _shown(hits: DataFrame, digits: int = 6) -> DataFrame:
    return hits.withColumn("score", F.round("score", digits))


def _hits(field: str | None, query: str) -> Query:
    return lambda spark, sf: _shown(search(_articles(spark, sf), query, field)).select(
        "doc_id", "category", "link", "score"
    )


def _everywhere(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of one category, with one word in every text."""
    articles = _articles(spark, sf).withColumn("category", F.lit("news"))
    return articles.withColumn("short_description", F.concat(F.lit("reuters "), "short_description"))


def search_word_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    hits = search(_everywhere(spark, sf), "reuters", "short_description")
    return _shown(hits, 12).select("doc_id", "score")


def search_keyword_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(search(_everywhere(spark, sf), "news", "category"), 12).select("doc_id", "score")


def hit_documents(spark: SparkSession, sf: str) -> DataFrame:
    return search(_enriched(spark, sf), THREE_WORDS).select(
        "doc_id", *RAW_FIELDS, F.col("sentiment_score").cast("double").alias("sentiment_score"), "sentiment_polarity"
    )


def _rounded(words: DataFrame) -> DataFrame:
    return words.withColumn("score", F.round("score", 9))


def significant(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(significant_words(_articles(spark, sf), WORD))


def significant_several(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(significant_words(_articles(spark, sf), WORDS, max_words=40))


def significant_headline(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(significant_words(_articles(spark, sf), "the", "headline", 25))


def foreground_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return foreground_background(_articles(spark, sf), WORD)


def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    entries = term_tables.postings(_articles(spark, sf))
    return term_tables.document_frequencies(entries, "field")


def corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return term_tables.corpus_statistics(term_tables.postings(_articles(spark, sf)))


def row_lengths(spark: SparkSession, sf: str) -> DataFrame:
    entries = term_tables.postings(_articles(spark, sf))
    return entries.where("is_first").select(
        "field", "doc_id", F.col("length").cast("bigint").alias("length")
    )


# -- published tables -------------------------------------------------------------------


def search_in_published(spark: SparkSession, sf: str) -> DataFrame:
    warehouse = _published(spark, sf, term_tables=True)
    hits = search_published(*warehouse.view(), THREE_WORDS)
    return _shown(hits).select("link", "score")


def search_field_in_published(spark: SparkSession, sf: str) -> DataFrame:
    warehouse = _published(spark, sf, term_tables=True)
    hits = search_published(*warehouse.view(), WORDS, "short_description")
    return _shown(hits).select("link", "score")


def search_everywhere_in_published(spark: SparkSession, sf: str) -> DataFrame:
    def lines(session: SparkSession, folder: str) -> DataFrame:
        rows = _everywhere(session, folder)
        return rows.select("doc_id", F.to_json(F.struct(*RAW_FIELDS)).alias("value"))

    hits = ask.fulltext_search(_published(spark, sf, lines, term_tables=True), "reuters", "short_description")
    return _shown(hits, 12).select("link", "score")


def significant_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return ask.significant_sizes(_published(spark, sf, term_tables=True), WORD)


def category_stats_sized(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest categories, and how many rows are in others."""
    warehouse = _published(spark, sf, term_tables=True)
    top = ask.category_stats(warehouse, "ther", size=3)
    rest = ask.category_remainder(warehouse, "ther", size=3)
    others = rest.select(F.lit("(others)").alias("key"), F.col("sum_other_doc_count").alias("doc_count"))
    return top.unionByName(others)


def significant_in_published(spark: SparkSession, sf: str) -> DataFrame:
    warehouse = _published(spark, sf, term_tables=True)
    return _rounded(significant_words_from_terms(*warehouse.view(), WORD))


def category_stats_in_published(spark: SparkSession, sf: str) -> DataFrame:
    return ask.category_stats(_published(spark, sf, term_tables=True), "ther")


def sentiment_stats_in_published(spark: SparkSession, sf: str) -> DataFrame:
    return ask.sentiment_stats(_published(spark, sf, term_tables=True), WORDS)


def full_refresh_publish(spark: SparkSession, sf: str) -> DataFrame:
    warehouse = _published(spark, sf)
    return warehouse.scan().select(
        *RAW_FIELDS,
        F.col("date_ts").cast("string").alias("moment"),
        F.col("sentiment_score").cast("double").alias("sentiment_score"),
        "sentiment_polarity",
    )


def published_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """By its stable name, after a second refresh with other rows."""
    warehouse = _published(spark, sf)
    odd = fixtures.write_lines(fixtures.damaged_lines(spark, sf), "damaged")
    refresh(warehouse, fixtures.lexicon(spark), RefreshOptions(odd, max_news=None))
    return spark.table(ALIAS).select("category", "link")


def published_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    def twice(session: SparkSession, folder: str) -> DataFrame:
        lines = fixtures.article_lines(session, folder)
        return lines.unionAll(lines)

    articles = _published(spark, sf, twice, n_partitions=4).scan()
    return articles.groupBy("link").agg(
        F.count("*").alias("copies"), F.count_distinct("doc_id").alias("ids")
    )


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    warehouse = _warehouse(spark)
    junk = documents(spark, sf).where("doc_id % 5 = 0").select("doc_id", F.lit("{}").alias("value"))
    lines = fixtures.dated_lines(spark, sf).unionByName(junk)
    options = RefreshOptions(fixtures.write_lines(lines, "dated"))
    refresh(warehouse, fixtures.lexicon(spark), options)
    return refresh(warehouse, fixtures.lexicon(spark), options).as_frame(spark).select(*SUMMARY)


def refresh_after_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every kept version after two refreshes, a move back and a third one."""
    warehouse = _warehouse(spark)
    whole = fixtures.write_lines(fixtures.article_lines(spark, sf), "news")
    odd = fixtures.write_lines(fixtures.damaged_lines(spark, sf), "damaged")

    def run(source: str) -> None:
        refresh(warehouse, fixtures.lexicon(spark), RefreshOptions(source, leave_old=True))

    run(whole)
    run(odd)
    warehouse.publish("articles_1")
    run(odd)
    counts = None
    for table in warehouse.tables():
        named = warehouse.read(table).groupBy(
            F.lit(table).alias("name"), F.lit(table == warehouse.published()).alias("published")
        )
        rows = named.agg(F.count("*").alias("n"))
        counts = rows if counts is None else counts.unionByName(rows)
    return counts


class _Interrupted(Warehouse):
    """Runs something between what a writer has seen and what it does then."""

    def __init__(self, spark: SparkSession, root: str, before_publish=None, before_commit=None):
        super().__init__(spark, root)
        self._before_publish, self._before_commit = before_publish, before_commit

    def publish_after(self, *args, **kwargs) -> bool:
        if self._before_publish is not None:
            self._before_publish()
        return super().publish_after(*args, **kwargs)

    def commit_batch(self, *args, **kwargs) -> bool:
        if self._before_commit is not None:
            self._before_commit()
        return super().commit_batch(*args, **kwargs)


def refresh_concurrent(spark: SparkSession, sf: str) -> DataFrame:
    """Two refreshes that overlap: rows of the tables that are left, and how they ended."""
    plain, lexicon = _warehouse(spark), fixtures.lexicon(spark)
    whole = fixtures.write_lines(fixtures.article_lines(spark, sf), "news")
    odd = fixtures.write_lines(fixtures.damaged_lines(spark, sf), "damaged")
    refresh(plain, lexicon, RefreshOptions(whole))
    slow = _Interrupted(spark, plain.root, lambda: refresh(plain, lexicon, RefreshOptions(odd)))
    try:
        ended = refresh(slow, lexicon, RefreshOptions(whole)).new_index_name
    except ValueError:
        ended = "has not published"
    plain.sweep(retain_ms=0)
    (table,) = plain.tables()
    named = plain.read(table).groupBy(F.lit(table).alias("name"), F.lit(ended).alias("other"))
    return named.agg(F.count("*").alias("n"))


def version_numbers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    signed = F.when(F.col("doc_id") % 3 == 0, F.lit("_")).when(F.col("doc_id") % 3 == 1, F.lit("_+"))
    name = F.concat("source", F.coalesce(signed, F.lit("_v")), key)
    names = documents(spark, sf).select(name.alias("name"))
    version = F.coalesce(version_of(F.col("name")), F.lit(-1).cast("bigint"))
    return names.select("name", version.alias("version"))


def snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    warehouse, repository = _published(spark, sf), scratch_folder(spark, "snapshots")
    take_snapshot(warehouse, repository, "first")
    restored = _warehouse(spark)
    restore_snapshot(restored, repository, "first")
    return restored.scan().select(*RAW_FIELDS, "sentiment_polarity")


def snapshot_restore_subset(spark: SparkSession, sf: str) -> DataFrame:
    warehouse, repository = _warehouse(spark), scratch_folder(spark, "snapshots")
    whole = fixtures.write_lines(fixtures.article_lines(spark, sf), "news")
    odd = fixtures.write_lines(fixtures.damaged_lines(spark, sf), "damaged")
    for source in (whole, odd):
        options = RefreshOptions(source, max_news=None, leave_old=True)
        refresh(warehouse, fixtures.lexicon(spark), options)
    take_snapshot(warehouse, repository, "both")
    restored = _warehouse(spark)
    restore_snapshot(restored, repository, "both", "articles_2")
    return restored.scan().select("link", "sentiment_polarity")


def snapshot_of_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Restored from the second of two snapshots, which shares what had not changed."""
    half = fixtures.article_lines(spark, sf).where("doc_id % 2 = 0")
    warehouse, repository = _published(spark, sf, lambda *_: half), scratch_folder(spark, "snapshots")
    take_snapshot(warehouse, repository, "half")
    _follow(warehouse, spark, fixtures.article_lines(spark, sf).where("doc_id % 2 = 1"))
    take_snapshot(warehouse, repository, "whole")
    restored = _warehouse(spark)
    restore_snapshot(restored, repository, "whole")
    return restored.scan().select(*RAW_FIELDS, "sentiment_polarity")


def match_link_published(spark: SparkSession, sf: str) -> DataFrame:
    found = ask.matching(_published(spark, sf), "doc://17", "link")
    return found.select("link", "category")


# -- streams ------------------------------------------------------------------------------


def stream_follow_files(spark: SparkSession, sf: str) -> DataFrame:
    warehouse = _warehouse(spark)
    source = fixtures.write_lines(fixtures.damaged_lines(spark, sf), "damaged")
    checkpoint = scratch_folder(spark, "follow")
    follow_files(warehouse, fixtures.lexicon(spark), source, checkpoint).awaitTermination()
    return warehouse.scan().select(*RAW_FIELDS, "sentiment_polarity")


def _follow(warehouse: Warehouse, spark: SparkSession, lines: DataFrame) -> None:
    source, checkpoint = fixtures.write_lines(lines, "followed"), scratch_folder(spark, "follow")
    follow_files(warehouse, fixtures.lexicon(spark), source, checkpoint).awaitTermination()
    Folder(spark, source).delete("")  # the lines are in the table


def stream_two_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two folders followed into one table; how many ids and rows each link has."""
    warehouse = _warehouse(spark)
    _follow(warehouse, spark, fixtures.damaged_lines(spark, sf))
    _follow(warehouse, spark, fixtures.article_lines(spark, sf))
    return warehouse.scan().groupBy("link").agg(
        F.count("*").alias("copies"), F.count_distinct("doc_id").alias("ids")
    )


def stream_search_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the articles by refresh, with term tables; the others followed; then asked."""
    half = fixtures.article_lines(spark, sf).where("doc_id % 2 = 0")
    others = fixtures.article_lines(spark, sf).where("doc_id % 2 = 1")
    warehouse = _published(spark, sf, lambda *_: half, term_tables=True)
    _follow(warehouse, spark, others)
    if not warehouse.has_terms(warehouse.published()):
        raise ValueError("the term tables do not follow the appends")
    hits = _shown(ask.fulltext_search(warehouse, THREE_WORDS))
    return hits.select(F.round("score", 5).alias("score"))


def stream_scan_during_batch(spark: SparkSession, sf: str) -> DataFrame:
    """What is seen of a batch that is written and not committed yet, and afterwards."""
    half = fixtures.article_lines(spark, sf).where("doc_id % 2 = 0")
    plain = _published(spark, sf, lambda *_: half)
    during = []
    watched = _Interrupted(spark, plain.root, before_commit=lambda: during.append(plain.scan()))
    _follow(watched, spark, fixtures.article_lines(spark, sf).where("doc_id % 2 = 1"))
    before, after = during[0].select(F.lit("during").alias("moment"), "link"), plain.scan()
    return before.unionByName(after.select(F.lit("after").alias("moment"), "link"))


def _merged(spark: SparkSession, sf: str) -> Warehouse:
    """A third of the articles by refresh, two thirds followed in four batches; merged."""
    lines = fixtures.article_lines(spark, sf)
    warehouse = _published(spark, sf, lambda *_: lines.where("doc_id % 6 < 2"), term_tables=True)
    for k in range(2, 6):
        _follow(warehouse, spark, lines.where(F.col("doc_id") % 6 == k))
    if len(warehouse.compact(whole=True, retain_ms=0)) != 5:
        raise ValueError("the parts have not been merged")
    warehouse.sweep(retain_ms=0)
    return warehouse


def merged_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).scan().select(*RAW_FIELDS, "sentiment_polarity")


def merged_search(spark: SparkSession, sf: str) -> DataFrame:
    warehouse = _merged(spark, sf)
    if not warehouse.has_terms(warehouse.published()):
        raise ValueError("the term tables have not been merged")
    hits = _shown(ask.fulltext_search(warehouse, THREE_WORDS))
    return hits.select(F.round("score", 5).alias("score"))


def merged_significant_words(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ask.significant_words(_merged(spark, sf), WORD))


def stream_periodic_refresh(spark: SparkSession, sf: str) -> DataFrame:
    warehouse = _warehouse(spark)
    source = fixtures.write_lines(fixtures.article_lines(spark, sf), "news")
    runs = []
    options = RefreshOptions(source, max_news=None, leave_old=True)
    query = refresh_periodically(warehouse, fixtures.lexicon(spark), options, 3000, runs.append)
    while query.isActive and len(runs) < 2:
        query.awaitTermination(0.1)
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return warehouse.read("articles_2").select(*RAW_FIELDS, "sentiment_polarity")


QUERIES: dict[str, Query] = {
    "ndjson_scan_strict": ndjson_scan_strict,
    "first_n_rows": first_n_rows,
    "first_n_rows_one_file": first_n_rows_one_file,
    "date_conformance": date_conformance,
    "rejected_articles": rejected_articles,
    "tokenize": tokenize,
    "sentiment_enrich": sentiment_enrich,
    "sentiment_totals_large_lexicon": sentiment_totals_large_lexicon,
    "sentiment_large_lexicon": sentiment_large_lexicon,
    "match_any_token": match_any_token,
    "match_keyword": _matching("src3", "category"),
    "match_link": _matching("doc://17", "link"),
    "match_date": _matching("2018-05", "date"),
    "match_date_hour": match_date_hour,
    "match_date_minute": match_date_minute,
    "match_all": _matching(None, "short_description"),
    "match_polarity": match_polarity,
    "sentiment_stats": lambda spark, sf: sentiment_stats(_enriched(spark, sf), WORD),
    "sentiment_stats_all": lambda spark, sf: sentiment_stats(_enriched(spark, sf)),
    "category_stats": lambda spark, sf: category_stats(_articles(spark, sf), "ther"),
    "category_stats_all": lambda spark, sf: category_stats(_articles(spark, sf)),
    "category_stats_headline": lambda spark, sf: category_stats(_articles(spark, sf), "the", "headline"),
    "category_stats_date": lambda spark, sf: category_stats(_articles(spark, sf), "2018-03", "date"),
    "terms_with_other": terms_with_other,
    "terms_return_flags": lambda spark, sf: top_terms(_table(spark, sf, "lineitem"), "l_returnflag"),
    "terms_order_priorities_top_3": lambda spark, sf: top_terms(_table(spark, sf, "orders"), "o_orderpriority", 3),
    "terms_of_labels": terms_of_labels,
    "order_priorities_in_month": order_priorities_in_month,
    "event_types_of_day": event_types_of_day,
    "roles_mentioning": roles_mentioning,
    "match_text_bm25": _hits("short_description", WORDS),
    "match_text_repeated_words": _hits("short_description", "erst the erst"),
    "search_headline": _hits("headline", "the in"),
    "search_multi_field": _hits(None, THREE_WORDS),
    "search_keyword_field": _hits("category", "src7"),
    "search_date_field": _hits("date", "2018-02-03"),
    "search_word_everywhere": search_word_everywhere,
    "search_keyword_everywhere": search_keyword_everywhere,
    "hit_documents": hit_documents,
    "significant_words": significant,
    "significant_words_several": significant_several,
    "significant_words_headline": significant_headline,
    "foreground_background": foreground_sizes,
    "term_statistics": term_statistics,
    "corpus_statistics": corpus_statistics,
    "row_lengths": row_lengths,
    "search_published": search_in_published,
    "search_published_field": search_field_in_published,
    "search_everywhere_published": search_everywhere_in_published,
    "significant_sizes": significant_sizes,
    "category_stats_sized": category_stats_sized,
    "significant_words_published": significant_in_published,
    "category_stats_published": category_stats_in_published,
    "sentiment_stats_published": sentiment_stats_in_published,
    "full_refresh_publish": full_refresh_publish,
    "published_table_scan": published_table_scan,
    "published_duplicates": published_duplicates,
    "run_summary": run_summary,
    "refresh_after_rollback": refresh_after_rollback,
    "version_numbers": version_numbers,
    "refresh_concurrent": refresh_concurrent,
    "match_link_published": match_link_published,
    "merged_table_scan": merged_table_scan,
    "merged_search": merged_search,
    "merged_significant_words": merged_significant_words,
    "snapshot_of_appended": snapshot_of_appended,
    "stream_scan_during_batch": stream_scan_during_batch,
    "snapshot_roundtrip": snapshot_roundtrip,
    "snapshot_restore_subset": snapshot_restore_subset,
    "stream_follow_files": stream_follow_files,
    "stream_two_sources": stream_two_sources,
    "stream_search_appended": stream_search_appended,
    "stream_periodic_refresh": stream_periodic_refresh,
}
