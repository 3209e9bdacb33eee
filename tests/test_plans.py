"""Properties of plans that matter at scale."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import WORD
from newsloom.operators import postings as term_tables
from newsloom.operators import search as ranked
from newsloom.operators import significant
from newsloom.operators.match import match
from newsloom.operators.sentiment import enrich
from newsloom.operators.terms import category_stats, sentiment_stats
from newsloom.plans import fixtures
from newsloom.plans.refresh import publishable
from newsloom.schema import SEARCH_BOOSTS
from newsloom.sources.ndjson import read_articles
from newsloom.sources.storage import Folder
from newsloom.sources.warehouse import Warehouse

# A tokenised column mentions the pattern twice, in the usual and the long-word case.
ONCE = 2


@pytest.fixture()
def stored(spark, make_articles, tmp_path):
    path = str(tmp_path / "articles")
    make_articles({"short_description": "the cat"}, {"short_description": "dog"}).write.parquet(path)
    return spark.read.parquet(path)


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def segmentations(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count(WORD)


def test_each_text_is_segmented_once(stored, lexicon):
    raw = stored.drop("sentiment_score", "sentiment_polarity")
    field = "short_description"
    assert segmentations(match(stored, "cat")) == ONCE
    assert segmentations(category_stats(stored, "cat")) == ONCE
    assert segmentations(sentiment_stats(enrich(raw, lexicon))) == ONCE
    assert segmentations(significant.word_counts(stored, "cat", field)) == ONCE
    assert segmentations(significant.foreground_background(stored, "cat")) == ONCE
    assert segmentations(term_tables.postings(stored)) == ONCE
    assert segmentations(term_tables.document_frequencies(term_tables.postings(stored), "field")) == ONCE
    assert segmentations(ranked._term_weights(stored, Counter(["cat"]), list(SEARCH_BOOSTS))) == ONCE
    scores = ranked._score_text(stored, "cat dog", SEARCH_BOOSTS)
    assert segmentations(scores) == ONCE * len(SEARCH_BOOSTS) + ONCE


def test_ingest_is_one_narrow_stage(spark, lexicon, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    plan = physical(publishable(read_articles(spark, str(tmp_path)), lexicon))
    assert "Exchange" not in plan and "Join" not in plan
    # Each line is parsed into a variant once, and once more only if it may end early.
    assert plan.count("parseJson") == 2


def test_postings_need_no_shuffle(stored):
    assert "Exchange" not in physical(term_tables.postings(stored))


def test_counts_are_partial_before_the_shuffle(stored):
    plan = physical(significant.word_counts(stored, "cat"))
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_significant_words_scan_the_table_once(stored):
    """The words and the total share one shuffle."""
    words = significant.significant_words(stored, "cat")
    words.collect()
    assert "ReusedExchange" in physical(words)


def test_search_shuffles_neither_rows_nor_tokens(stored):
    plan = physical(ranked.search(stored, "cat dog").select("doc_id", "score"))
    main, _, subqueries = plan.partition("Subquery")
    assert "TakeOrderedAndProject" in main and "Exchange" not in main
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", subqueries)
    assert set(keys) == {"field"}


def test_the_plan_of_a_search_does_not_grow_with_the_query(stored):
    def size(n):
        query = " ".join(f"word{i}" for i in range(n))
        return physical(ranked.search(stored, query)).count("bin(")

    assert size(2) == size(200)


def test_value_filters_reach_the_scan(stored):
    assert "EqualTo(category,c1)" in physical(match(stored, "c1", "category"))
    assert "GreaterThanOrEqual(date_ts,2018-05-01" in physical(match(stored, "2018-05", "date"))


def test_only_needed_columns_are_read(stored):
    plan = physical(category_stats(stored, "cat"))
    assert re.search(r"ReadSchema: struct<category:string,short_description:string>", plan)


def test_published_significant_words_read_no_text(spark, stored, tmp_path):
    folder = str(tmp_path / "terms")
    term_tables.write_term_tables(stored, folder)
    words = significant.significant_words_from_terms(stored, folder, "cat")
    sizes = significant.sizes_from_terms(stored, folder, "cat")
    assert tuple(sizes.first()) == (1, 2)
    for frame in (words, sizes):
        assert "short_description:string" not in physical(frame) and segmentations(frame) == 0


def test_fetch_by_id_skips_files(spark, make_articles, lexicon, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "warehouse"))
    warehouse.write(make_articles(*[{"headline": f"w{i}"} for i in range(400)]), "articles_1", n_partitions=8)
    ranges = warehouse.read("articles_1").groupBy(F.input_file_name().alias("file"))
    bounds = sorted((r.low, r.high) for r in ranges.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect())
    assert len(bounds) == 8 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))


def test_bucket_of_a_frequent_word_is_split(spark, tmp_path):
    """A third of all postings is one word; its directory is written by many tasks."""
    words = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), "id"))
    rows = spark.range(0, 60_000, numPartitions=8).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", words, F.md5(F.col("id").cast("string"))).alias("text")
    )
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        term_tables.write_term_tables(rows, str(tmp_path), ("text",), n_buckets=4)
    finally:
        for name in settings:
            spark.conf.unset(name)
    entries = term_tables.read_term_table(spark, str(tmp_path), term_tables.POSTINGS)
    hot = entries.where("term = 'hot'")
    assert hot.count() == 40_000
    assert hot.select(F.input_file_name()).distinct().count() > 1
    frequencies = term_tables.read_term_table(spark, str(tmp_path), term_tables.TERM_DF)
    assert frequencies.where("term = 'hot'").first().df == 40_000


def test_one_file_is_joined_from_ranges_of_ids(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "PART_BYTES", 500)
    texts = [(i, f"line {i} é" if i % 7 else "") for i in range(300)] + [(299, "line 299 é"), (None, "none")]
    lines = spark.createDataFrame(texts, "doc_id bigint, value string").repartition(5)
    joined, join = [], fixtures.join_files
    monkeypatch.setattr(fixtures, "join_files", lambda *where: (joined.append(where[1]), join(*where)))
    folder = Folder(spark, fixtures.write_file(lines, "one"))
    (name,) = folder.files()
    first = sorted(texts, key=lambda row: -1 if row[0] is None else row[0])
    with open(folder.local_path(name), encoding="utf-8") as file:
        assert file.read() == "".join(f"{value}\n" for _, value in first)
    sizes = Folder(spark, joined[0]).file_sizes()
    assert len(sizes) > 4 and max(sizes.values()) < 2000
    assert fixtures.write_file(lines.limit(0), "none")
