"""Published search and significant words read the ranges of ids that matter, and no more."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import postings as term_tables
from newsloom.operators.postings import TermTables, few_ranges, in_ranges, ranges_of
from newsloom.operators.search import search, search_published
from newsloom.operators.significant import significant_words, significant_words_from_terms

from .test_commits import rows_read

WORDS = [f"w{k}" for k in range(30)]


@pytest.fixture()
def small_ranges(monkeypatch):
    """Every word in 20 rows is frequent, and a range has four ids."""
    monkeypatch.setattr(term_tables, "FREQUENT_ROWS", 20)
    monkeypatch.setattr(term_tables, "RANGE_BITS", 2)
    monkeypatch.setattr("newsloom.operators.search.RANGE_BITS", 2)
    monkeypatch.setattr("newsloom.operators.search.FIRST_RANGES", 2)


def some_text(rnd, longest):
    return " ".join(WORDS[int(30 * rnd.random() ** 2)] for _ in range(rnd.randint(0, longest)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    return [
        {"headline": some_text(rnd, 4), "authors": some_text(rnd, 2), "short_description": some_text(rnd, rnd.choice([3, 12, 40]))}
        for _ in range(400)
    ]


QUERIES = ["w0", "w29", "w1 w28", "w0 w1 w2 w2", "w3 nowhere"]


@pytest.mark.parametrize("parts", [1, 3])
def test_hits_are_those_of_the_scan(spark, make_articles, rows, small_ranges, tmp_path, parts):
    articles = make_articles(*rows)
    for k in range(parts):
        part = articles.where(F.col("doc_id") % parts == k)
        term_tables.write_term_tables(part, str(tmp_path), n_buckets=4, part=f"p{k}")
    tables = TermTables(spark, str(tmp_path), tuple(f"p{k}" for k in range(parts)))
    assert not tables.read(term_tables.PEAKS).isEmpty()
    cases = [(query, None, 10) for query in QUERIES]
    cases += [("w0 w1", "headline", 1), ("w1 w28", "short_description", 1), ("w0", "short_description", 500)]
    for query, field, size in cases:
        expected = [(r.doc_id, round(r.score, 6)) for r in search(articles, query, field, size).collect()]
        found = search_published(articles, tables, query, field, size)
        assert [(r.doc_id, round(r.score, 6)) for r in found.collect()] == expected, (query, field, size)


@pytest.mark.parametrize("slice_bytes", [1 << 25, 1])
def test_merged_tables_give_the_same_hits_in_slices(spark, make_articles, rows, small_ranges, tmp_path, monkeypatch, slice_bytes):
    monkeypatch.setattr(term_tables, "SLICE_BYTES", slice_bytes)
    test_merged_tables_give_the_same_hits(spark, make_articles, rows, None, tmp_path)
    whole = TermTables(spark, f"{tmp_path}/whole", ("all",))
    term_tables.write_term_tables(make_articles(*rows), whole.folder, n_buckets=4, part="all")
    merged = TermTables(spark, str(tmp_path), ("all",))
    for table in (term_tables.ROW_TERMS, term_tables.POSTINGS, term_tables.TERM_DF, term_tables.PEAKS, term_tables.CORPUS):
        assert sorted(merged.read(table).collect()) == sorted(whole.read(table).collect()), table
    texts = [path for path in merged.read(term_tables.ROW_TERMS).inputFiles() if "field=short_description" in path]
    assert len(texts) >= (8 if slice_bytes == 1 else 1)


def test_slices_have_every_row_once(spark):
    ids = spark.createDataFrame([(i,) for i in [None, None, *range(50), *[7] * 30, 1 << 40]], "doc_id long")
    for n in (0, 1, 3, 8):
        parts = [ids.where(within) for within in term_tables.slices_of_ids(ids, n)]
        assert 1 <= len(parts) <= max(n, 1)
        found = [row.doc_id for part in parts for row in part.collect()]
        assert sorted(found, key=str) == sorted((r.doc_id for r in ids.collect()), key=str)
    assert len(term_tables.slices_of_ids(ids.where("doc_id IS NULL"), 8)) == 1
    assert len(term_tables.slices_of_ids(spark.range(1000).toDF("doc_id"), 8)) == 8


def test_words_of_matching_rows_are_not_shuffled(make_articles, rows, tmp_path):
    articles = make_articles(*rows)
    term_tables.write_term_tables(articles, str(tmp_path), n_buckets=4)
    found = significant_words_from_terms(articles, str(tmp_path), "w1 w28")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and found.collect() == significant_words(articles, "w1 w28").collect() != []


def test_merged_tables_give_the_same_hits(spark, make_articles, rows, small_ranges, tmp_path):
    articles = make_articles(*rows)
    for k in range(3):
        part = articles.where(F.col("doc_id") % 3 == k)
        term_tables.write_term_tables(part, str(tmp_path), n_buckets=4, part=f"p{k}")
    term_tables.merge_term_tables(TermTables(spark, str(tmp_path), ("p0", "p1", "p2")), "all")
    merged = TermTables(spark, str(tmp_path), ("all",))
    for query in ("w0", "w1 w28"):
        expected = [(r.doc_id, round(r.score, 6)) for r in search(articles, query).collect()]
        assert [(r.doc_id, round(r.score, 6)) for r in search_published(articles, merged, query).collect()] == expected
        words = significant_words(articles, query).collect()
        assert significant_words_from_terms(articles, merged, query).collect() == words


def test_bound_is_reached_by_no_row(spark, make_articles, rows, tmp_path):
    """Whatever the mean length is, and however terms repeat."""
    from newsloom.functions.scores import highest_score, term_score

    entries = term_tables.postings(make_articles(*rows))
    bounds = term_tables.peaks(entries, "field")
    for mean in (1.0, 7.0, 300.0):
        ranged = entries.withColumn("id_range", term_tables.id_range(F.col("doc_id")))
        weight, mean_length = F.lit(1.5), F.lit(mean)
        most = highest_score(weight, F.col("max_tf"), F.col("least_ratio"), mean_length)
        score = term_score(weight, F.col("tf"), F.col("length"), mean_length)
        above = ranged.join(bounds, ["field", "term", "id_range"]).where(score > most * (1 + 1e-12))
        assert above.count() == 0


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """40,000 rows of one frequent word; few of them are short, and a few have a rare word."""
    folder = str(tmp_path_factory.mktemp("large"))
    short = F.col("id") % 10_007 == 5
    rare = F.when(F.col("id").isin(12, 13, 30_000), " rare")
    texts = F.concat(F.lit("hot"), F.when(short, "").otherwise(F.repeat(F.lit(" filler"), 30)), F.coalesce(rare, F.lit("")))
    rows = spark.range(0, 40_000, numPartitions=4).select(
        F.col("id").alias("doc_id"), F.lit("").alias("headline"), F.lit("").alias("authors"), texts.alias("short_description")
    )
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.setInt("parquet.page.row.count.limit", 100)
    saved = term_tables.FREQUENT_ROWS
    term_tables.FREQUENT_ROWS = 1000
    try:
        rows.write.parquet(f"{folder}/rows")
        term_tables.write_term_tables(rows, f"{folder}/terms", n_buckets=1)
    finally:
        term_tables.FREQUENT_ROWS = saved
        hadoop.unset("parquet.page.row.count.limit")
    return spark.read.parquet(f"{folder}/rows"), TermTables(spark, f"{folder}/terms", ("base",))


def test_frequent_word_reads_the_ranges_of_its_hits(spark, large, monkeypatch):
    articles, tables = large
    filters = []
    from newsloom.operators import search as ranked

    monkeypatch.setattr("newsloom.operators.search.FIRST_RANGES", 1)
    kept = ranked._ranges_of_hits
    monkeypatch.setattr(ranked, "_ranges_of_hits", lambda entries, *args: filters.append((entries, kept(entries, *args))) or filters[-1][1])
    hits = search_published(articles, tables, "hot", "short_description", 4).collect()
    assert [r.doc_id for r in hits] == [5, 10_012, 20_019, 30_026]
    (entries, condition), = filters
    # Four of ten ranges of 4,096 rows have a short row.
    assert rows_read(spark, entries) > 2 * rows_read(spark, entries.where(condition)) > 0


def test_significant_words_read_the_rows_near_matches(spark, large):
    articles, tables = large
    ids = tables.matching_ids("short_description", ["rare"])
    near = in_ranges(F.col("doc_id"), ranges_of(ids))
    rows = tables.read(term_tables.ROW_TERMS).where((F.col("field") == "short_description") & near)
    # Pages of a hundred rows: two of them have the matching rows.
    assert rows_read(spark, rows.select("doc_id", "terms")) <= 400
    expected = significant_words(articles.limit(40_000), "rare").collect()
    assert significant_words_from_terms(articles, tables, "rare").collect() == expected != []


def test_ranges_are_bounded_and_hold_everything(spark):
    rnd = random.Random(3)
    ids = sorted(rnd.sample(range(1 << 40), 3000))
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    for most in (1, 5, 100):
        ranges = ranges_of(frame, most)
        assert len(ranges) <= most and all(any(a <= i <= b for a, b in ranges) for i in ids)
    assert few_ranges(spark.createDataFrame([], "at bigint, low bigint, high bigint")) == []
    spread = [(i, i) for i in ids]
    assert frame.where(in_ranges(F.col("doc_id"), spread)).count() == 3000
    assert frame.where(in_ranges(F.col("doc_id"), spread[:200])).count() == 200
    assert frame.where(in_ranges(F.col("doc_id"), [])).count() == 0


def test_peaks_are_counted_without_moving_postings(spark, make_articles, rows, small_ranges, monkeypatch, tmp_path):
    seen = []
    made = term_tables.peaks
    monkeypatch.setattr(term_tables, "peaks", lambda entries, *keys: seen.append(entries) or made(entries, *keys))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the frequencies were large
    try:
        term_tables.write_term_tables(make_articles(*rows), str(tmp_path))
        (entries,) = seen
        assert "hashpartitioning" not in entries._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    tables = TermTables(spark, str(tmp_path))
    postings, found = tables.read(term_tables.POSTINGS), tables.read(term_tables.PEAKS)
    n = {(r.field, r.term): r["count"] for r in postings.groupBy("field", "term").count().collect()}
    frequent = {key: count for key, count in n.items() if count >= 20}
    of_peaks = {(r.field, r.term): r.n for r in found.groupBy("field", "term").agg(F.sum("n").alias("n")).collect()}
    assert frequent and of_peaks == frequent
