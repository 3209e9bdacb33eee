import datetime as dt
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.operators import postings as term_tables
from newsloom.operators import sentiment as sentiment_module
from newsloom.operators.match import match
from newsloom.operators.search import search, search_published
from newsloom.operators.sentiment import enrich, sentiment_totals, totals_by_join
from newsloom.operators.significant import (
    foreground_background,
    significant_words,
    significant_words_from_terms,
)
from newsloom.operators.terms import category_stats, sentiment_stats, terms_remainder, top_terms

TEXTS = [
    "the cat sat on the mat", "a dog and a cat", "dog eat dog", "", "the the the",
    "Cat! cat? CAT.", "birds sing", "the dog sings", "mat for a cat and dog", "quiet",
]


@pytest.fixture()
def articles(make_articles):
    return make_articles(
        *[
            {
                "short_description": text,
                "headline": text.split(" ")[-1],
                "authors": "Jane Roe" if i % 3 else "Cat Stevens",
                "category": f"c{i % 3}",
                "link": f"l{i}",
                "date_ts": dt.datetime(2018, 5, 20 + i),
            }
            for i, text in enumerate(TEXTS)
        ]
    )


def ids(frame):
    return sorted(r.doc_id for r in frame.collect())


@pytest.mark.parametrize(
    ("query", "field", "expected"),
    [
        ("dog", "short_description", [1, 2, 7, 8]),
        ("DOG mat", "short_description", [0, 1, 2, 7, 8]),
        ("do", "short_description", []),
        ("!!!", "short_description", []),
        ("c1", "category", [1, 4, 7]),
        ("C1", "category", []),
        ("c1 c2", "category", []),
        ("l3", "link", [3]),
        ("stevens", "authors", [0, 3, 6, 9]),
        ("2018-05-24", "date", [4]),
        ("2018-05", "date", list(range(10))),
        ("2017", "date", []),
        ("x", "no such field", []),
        ("Positive", "sentiment_polarity", list(range(10))),
        (None, "short_description", list(range(10))),
    ],
)
def test_match(articles, query, field, expected):
    assert ids(match(articles, query, field)) == expected


@pytest.mark.parametrize("query", ["", " ", "\t\n", "　"])
def test_blank_queries_are_refused(articles, query):
    for ask in (match, search, category_stats, significant_words, foreground_background):
        with pytest.raises(ValueError, match="blank"):
            ask(articles, query)


def test_unindexed_and_malformed_fields_are_refused(articles):
    for ask in (match, search):
        with pytest.raises(ValueError, match="not indexed"):
            ask(articles, "1", "sentiment_score")
        with pytest.raises(ValueError, match="date"):
            ask(articles, "yesterday", "date")
    with pytest.raises(ValueError, match="date"):
        match(articles, "2018-02-30", "date")
    for field in ("category", "date", "no such field"):
        with pytest.raises(ValueError, match="text field"):
            significant_words(articles, "x", field)
    with pytest.raises(ValueError, match="max_words"):
        significant_words(articles, "x", max_words=0)


def test_counts_and_remainder(make_articles):
    rows = [{"category": f"k{i:02d}"} for i in range(14) for _ in range(1 + i % 3)]
    rows += [{"category": ""}] * 4
    frame = make_articles(*rows)
    counts = Counter(r["category"] for r in rows)
    expected = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    assert [tuple(r) for r in category_stats(frame).collect()] == expected[:10]
    assert [tuple(r) for r in top_terms(frame, "category", 3).collect()] == expected[:3]
    assert tuple(terms_remainder(frame, "category").first()) == (sum(n for _, n in expected[10:]), 0)
    nothing = frame.where("false")
    assert category_stats(nothing).count() == 0
    assert tuple(terms_remainder(nothing, "category").first()) == (0, 0)


def test_stats_of_matching_rows(articles):
    assert [tuple(r) for r in category_stats(articles, "dog").collect()] == [("c1", 2), ("c2", 2)]
    assert [tuple(r) for r in sentiment_stats(articles, "2018-05-22", "date").collect()] == [("Positive", 1)]


SENTIMENT = [
    ("the of erst", 6, 0), ("in and", 0, 3), ("in the", 2, 2), ("nothing", 0, 0), ("", 0, 0),
    ("in in in the", 2, 6), ("THE, the; The!", 6, 0), ("other", 0, 0),
]


@pytest.mark.parametrize("way", ["literal", "table", "join"])
def test_sentiment(make_articles, lexicon, monkeypatch, way):
    if way != "literal":
        monkeypatch.setattr(sentiment_module, "MAX_LITERAL_WORDS", 2)
    if way == "join":
        monkeypatch.setattr(sentiment_module, "MAX_TABLE_WORDS", 2)
    frame = make_articles(*[{"short_description": text} for text, _, _ in SENTIMENT])
    raw = frame.drop("sentiment_score", "sentiment_polarity")
    totals = sentiment_totals(raw, lexicon, "short_description").orderBy("doc_id").collect()
    assert [(r.positive, r.negative) for r in totals] == [(p, n) for _, p, n in SENTIMENT]
    rows = enrich(raw, lexicon).orderBy("doc_id").collect()
    assert [(r.sentiment_score, r.sentiment_polarity) for r in rows] == [
        (n, "Negative") if n > p else (p, "Positive") for _, p, n in SENTIMENT
    ]


def test_empty_lexicon(make_articles, lexicon):
    raw = make_articles({"short_description": "the"}).drop("sentiment_score", "sentiment_polarity")
    row = enrich(raw, lexicon.where("false")).first()
    assert (row.sentiment_score, row.sentiment_polarity) == (0.0, "Positive")


def test_narrow_sentiment_has_no_shuffle(make_articles, lexicon):
    raw = make_articles({"short_description": "the"}).drop("sentiment_score", "sentiment_polarity")
    plan = enrich(raw, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("most", [1, 20_000])
@pytest.mark.parametrize(
    "rows, message",
    [([("the", 1), ("the", 1)], "more than once"), ([("the", 1), (None, 2)], "without"), ([("a", None)], "without")],
)
def test_lexicons_with_repeated_or_empty_words_are_refused(spark, make_articles, monkeypatch, most, rows, message):
    monkeypatch.setattr(sentiment_module, "MAX_LITERAL_WORDS", most)
    lexicon = spark.createDataFrame(rows, "word string, valence int")
    with pytest.raises(ValueError, match=message):
        sentiment_totals(make_articles({"short_description": "the"}), lexicon, "short_description")


def test_join_segments_once_and_shuffles_no_text_with_the_lexicon(spark, lexicon, make_articles):
    rows = make_articles({"short_description": "the the in"}, {"short_description": "x"})
    for small in (True, False):
        totals = totals_by_join(rows, lexicon, "short_description", small=small)
        assert [(r.positive, r.negative) for r in totals.orderBy("doc_id").collect()] == [(4, 2), (0, 0)]


def test_hot_word_by_join(spark, lexicon):
    """One word fills most texts; every row is kept and counted."""
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 10 == 0, "quiet").otherwise("the the in").alias("text"),
    )
    totals = totals_by_join(rows, lexicon, "text")
    found = {(r.positive, r.negative): r.n for r in totals.groupBy("positive", "negative").agg(F.count("*").alias("n")).collect()}
    assert found == {(4, 2): 2700, (0, 0): 300}


def test_large_lexicon_shuffles_no_text(spark, make_articles, monkeypatch):
    """Words of one slot, words without a slot and a word in every text."""
    words = [(f"w{k}", k % 7 - 3) for k in range(3000)]
    lexicon = spark.createDataFrame(words, "word string, valence int")
    texts = [" ".join(f"w{(i * 37 + j * j) % 4000}" for j in range(i % 50)) + " w2 W2" for i in range(200)]
    rows = make_articles(*[{"short_description": t} for t in texts])
    monkeypatch.setattr(sentiment_module, "MAX_LITERAL_WORDS", 10)
    found = sentiment_totals(rows, lexicon, "short_description")
    valences = dict(words)
    expected = []
    for text in texts:
        values = [valences.get(t, 0) for t in simple_tokens(text)]
        expected.append((sum(v for v in values if v > 0), -sum(v for v in values if v < 0)))
    assert [(r.positive, r.negative) for r in found.orderBy("doc_id").collect()] == expected
    plan = enrich(rows.drop("sentiment_score", "sentiment_polarity"), lexicon)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main


def simple_tokens(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def by_hand(rows, query, boosts):
    """Scores by the formulas, row by row."""
    scores = {}
    for field, boost in boosts.items():
        tokens = [simple_tokens(row[field]) for row in rows]
        lengths = [len(t) for t in tokens if t]
        n, mean = len(lengths), sum(lengths) / max(len(lengths), 1)
        for row, words in zip(rows, tokens):
            total = 0.0
            for term in simple_tokens(query):
                df, tf = sum(term in t for t in tokens), words.count(term)
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                total += 2.2 * idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)) if tf else 0
            scores[row.doc_id] = max(scores.get(row.doc_id, 0), boost * total)
    ranked = sorted(((round(s, 6), i) for i, s in scores.items() if s > 0), key=lambda p: (-p[0], p[1]))
    return [(i, s) for s, i in ranked[:10]]


BOOSTS = {"headline": 2.0, "authors": 1.0, "short_description": 1.0}


@pytest.mark.parametrize("query", ["cat", "the dog", "cat cat stevens", "mat for birds", "nowhere", "!!!"])
@pytest.mark.parametrize("field", [None, "short_description", "authors"])
def test_search_by_hand(spark, articles, tmp_path, query, field):
    boosts = BOOSTS if field is None else {field: 1.0}
    expected = [] if query == "!!!" else by_hand(articles.collect(), query, boosts)
    hits = search(articles, query, field)
    assert hits.columns == [*articles.columns, "score"]
    assert [(r.doc_id, round(r.score, 6)) for r in hits.collect()] == expected
    term_tables.write_term_tables(articles, str(tmp_path), n_buckets=4)
    published = search_published(articles, str(tmp_path), query, field)
    assert [(r.doc_id, round(r.score, 6)) for r in published.collect()] == expected


def test_search_of_other_fields(articles):
    hits = search(articles, "c1", "category").collect()
    assert [r.doc_id for r in hits] == [1, 4, 7]
    assert {round(r.score, 9) for r in hits} == {round(math.log(1 + (10 - 3 + 0.5) / 3.5), 9)}
    assert [(r.doc_id, r.score) for r in search(articles, "2018-05-24", "date").collect()] == [(4, 1.0)]
    assert search(articles, "x", "no such field").collect() == []
    assert search(articles, "c9", "category").collect() == []


def test_search_ties_and_size(make_articles):
    frame = make_articles(*[{"short_description": "same words"}] * 25)
    assert [r.doc_id for r in search(frame, "same").collect()] == list(range(10))
    assert [r.doc_id for r in search(frame, "same", size=3).collect()] == [0, 1, 2]


def test_term_in_every_row_of_a_large_table(spark):
    """Its weight is tiny, and its rows are hits all the same."""
    rows = spark.range(0, 3_000_000, numPartitions=8).select(
        F.col("id").alias("doc_id"),
        F.lit("news").alias("category"),
        F.when(F.col("id") == 2_500_000, "news news").otherwise("news").alias("headline"),
    )
    fields = {"category": "keyword", "headline": "text"}
    hits = search(rows, "news", "category", fields=fields).collect()
    assert [h.doc_id for h in hits] == list(range(10)) and all(0 < h.score < 1e-6 for h in hits)
    hits = search(rows, "news", "headline", fields=fields).collect()
    assert [h.doc_id for h in hits] == [2_500_000, *range(9)] and all(0 < h.score < 1e-6 for h in hits)


def test_many_hits_are_joined(spark, articles, tmp_path, monkeypatch):
    term_tables.write_term_tables(articles, str(tmp_path), n_buckets=4)
    few = search_published(articles, str(tmp_path), "cat dog").collect()
    monkeypatch.setattr("newsloom.operators.search.MOST_FILTERED", 1)
    assert search_published(articles, str(tmp_path), "cat dog").collect() == few != []


def test_query_longer_than_the_substring_tests(make_articles):
    frame = make_articles(*[{"short_description": f"w{i} filler"} for i in range(60)])
    query = " ".join(f"w{i}" for i in range(40, 60))
    assert [r.doc_id for r in search(frame, query).collect()] == list(range(40, 50))


def test_significant_words_by_hand(make_articles, tmp_path, spark):
    texts = ["cat milk"] * 4 + ["cat dog"] * 2 + ["dog bone milk"] * 6 + ["", "bone"] * 4
    frame = make_articles(*[{"short_description": t} for t in texts])
    rows = [set(t.split()) for t in texts]
    fg = [r for r in rows if "cat" in r]
    expected = []
    for word in set().union(*rows):
        f, b = sum(word in r for r in fg), sum(word in r for r in rows)
        fp, bp = f / len(fg), b / len(rows)
        if f >= 3 and fp > bp:
            expected.append((word, f, pytest.approx((fp - bp) * fp / bp), b))
    expected.sort(key=lambda e: (-e[2].expected, e[0]))
    found = significant_words(frame, "cat")
    assert found.columns == ["key", "doc_count", "score", "bg_count"]
    assert [tuple(r) for r in found.collect()] == expected
    assert tuple(foreground_background(frame, "cat").first()) == (len(fg), len(rows))
    term_tables.write_term_tables(frame, str(tmp_path), n_buckets=3)
    from_terms = significant_words_from_terms(frame, str(tmp_path), "cat")
    assert [tuple(r) for r in from_terms.collect()] == expected
    assert significant_words_from_terms(frame, str(tmp_path), "!!!").collect() == []
    assert significant_words(frame, "!!!").collect() == []
    assert len(significant_words(frame, "cat", max_words=1).collect()) == 1


def test_term_tables(spark, articles, tmp_path):
    term_tables.write_term_tables(articles, str(tmp_path), n_buckets=4)
    entries = term_tables.read_term_table(spark, str(tmp_path), term_tables.POSTINGS)
    expected = {
        (field, term, row.doc_id, tf, len(simple_tokens(row[field])))
        for row in articles.collect()
        for field in BOOSTS
        for term, tf in Counter(simple_tokens(row[field])).items()
    }
    found = [(r.field, r.term, r.doc_id, r.tf, r.length) for r in entries.collect()]
    assert len(found) == len(expected) and set(found) == expected
    frequencies = term_tables.read_term_table(spark, str(tmp_path), term_tables.TERM_DF)
    counts = Counter((f, t) for f, t, *_ in expected)
    assert {(r.field, r.term): r.df for r in frequencies.collect()} == dict(counts)
    corpus = term_tables.read_term_table(spark, str(tmp_path), term_tables.CORPUS).collect()
    for row in corpus:
        rows = {(d, n) for f, _, d, _, n in expected if f == row.field}
        assert (row.n_docs, row.n_tokens) == (len(rows), sum(n for _, n in rows))


def test_published_search_reads_only_its_buckets(spark, articles, tmp_path):
    term_tables.write_term_tables(articles, str(tmp_path), n_buckets=4)
    entries = term_tables.read_term_table(spark, str(tmp_path), term_tables.POSTINGS)
    bucket = term_tables.bucket_of(F.lit("cat"), 4)
    one = entries.where((F.col("field") == "headline") & (F.col("bucket") == bucket) & (F.col("term") == "cat"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "EqualTo(term,cat)" in plan
