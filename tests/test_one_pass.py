"""Work that is done once, or for few rows only."""

from collections import Counter

from pyspark.sql import functions as F

from newsloom.functions.text import tokenise
from newsloom.operators import search as ranked
from newsloom.operators.postings import grouped_terms, terms_of_rows
from newsloom.plans import fixtures
from newsloom.schema import SEARCH_BOOSTS


def test_search_makes_other_columns_for_hits_only(make_articles):
    rows = [{"doc_id": i, "short_description": "cat" + " dog" * (i % 5) if i % 7 == 0 else "bird"} for i in range(70)]
    articles = make_articles(*rows)
    costly = F.when(F.col("short_description").contains("bird"), F.raise_error(F.lit("no hit"))).otherwise(F.col("doc_id"))
    hits = ranked.search(articles.withColumn("costly", costly), "cat", "short_description", 3).collect()
    assert len(hits) == 3 and all(hit.costly == hit.doc_id for hit in hits)


def test_search_of_repeated_ids_and_no_id(make_articles):
    texts = ["cat", "cat dog", "", "dog cat cat", "bird", "cat " * 300]
    articles = make_articles(*[{"doc_id": i % 3, "short_description": text} for i, text in enumerate(texts * 2)])
    articles = articles.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    for size in (1, 2, 5, 20):
        found = ranked.search(articles, "cat dog", size=size).collect()
        best = ranked._best(ranked._score_text(articles, "cat dog", SEARCH_BOOSTS), size).collect()
        assert [(r.doc_id, round(r.score, 9)) for r in found] == [(r.doc_id, round(r.score, 9)) for r in best]
        assert Counter(r.short_description for r in found) == Counter(r.short_description for r in best)


def test_large_lexicon_is_made_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One, two two.", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lexicon = fixtures.large_lexicon(spark, str(tmp_path))
    assert "regexp" not in lexicon._jdf.queryExecution().toString()
    assert sorted(map(tuple, lexicon.collect())) == [("one", 1), ("two", 1)]


def test_terms_of_rows_are_counted(spark):
    texts = ["b a b, c", "", None, "été über ñandú été.", "x" * 600 + " y", "x" * 255 + " z z", "a" * 256]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = {r.doc_id: r.tokens for r in df.select("doc_id", tokenise(F.col("text")).alias("tokens")).collect()}
    assert tokens[3] == ["été", "über", "ñandú", "été"] and [len(t) for t in tokens[4]] == [255, 255, 90, 1]
    assert [len(t) for t in tokens[5]] == [255, 1, 1] and [len(t) for t in tokens[6]] == [255, 1]
    for row in terms_of_rows(df, ["doc_id"], "text").collect():
        of_row = tokens[row.doc_id]
        assert list(zip(row.terms, row.tfs)) == sorted(Counter(of_row or []).items())
        assert row.length == (None if of_row is None else len(of_row))
    for row in grouped_terms(df, ["doc_id"], "text").collect():
        assert [tuple(e) for e in row.entries] == sorted(Counter(tokens[row.doc_id] or []).items())
