import json

import pytest

import newsloom
from newsloom.schema import RAW_FIELDS

TEXTS = ["the cat sat", "the dog", "in the end", "in and in", "cat and dog and cat", "erst of the day"]


@pytest.fixture(params=[False, True], ids=["scan", "term tables"])
def warehouse(spark, tmp_path, lexicon, request):
    rows = [
        dict.fromkeys(RAW_FIELDS, "x") | {"short_description": t, "category": f"c{i % 2}", "date": "2018-05-26"}
        for i, t in enumerate(TEXTS * 4)
    ]
    (tmp_path / "news.json").write_text("\n".join(map(json.dumps, rows)))
    warehouse = newsloom.Warehouse(spark, str(tmp_path / "warehouse"))
    options = newsloom.RefreshOptions(str(tmp_path / "news.json"), term_tables=request.param)
    newsloom.refresh(warehouse, lexicon, options)
    assert warehouse.has_terms(warehouse.published()) == request.param
    return warehouse


def test_questions(warehouse):
    hits = newsloom.fulltext_search(warehouse, "cat").collect()
    assert [h.short_description for h in hits] == ["cat and dog and cat"] * 4 + ["the cat sat"] * 4
    assert [h.doc_id for h in hits] == [4, 10, 16, 22, 0, 6, 12, 18]
    assert len(newsloom.fulltext_search(warehouse, "c1", "category").collect()) == 10
    words = newsloom.significant_words(warehouse, "cat", max_words=2).collect()
    assert [(w.key, w.doc_count, w.bg_count) for w in words] == [("cat", 8, 8), ("sat", 4, 4)]
    assert [tuple(r) for r in newsloom.sentiment_stats(warehouse).collect()] == [("Positive", 16), ("Negative", 8)]
    assert [tuple(r) for r in newsloom.sentiment_stats(warehouse, "cat").collect()] == [("Negative", 4), ("Positive", 4)]
    assert [tuple(r) for r in newsloom.category_stats(warehouse, "dog").collect()] == [("c0", 4), ("c1", 4)]
    assert [tuple(r) for r in newsloom.category_stats(warehouse, "dog cat").collect()] == [("c0", 8), ("c1", 4)]
    assert [tuple(r) for r in newsloom.category_stats(warehouse, "c1", "category").collect()] == [("c1", 12)]
    assert newsloom.category_stats(warehouse, "!!!").collect() == []
    assert newsloom.category_stats(warehouse, "x", "no such field").collect() == []
    assert newsloom.significant_words(warehouse, "!!!").collect() == []
    with pytest.raises(ValueError, match="blank"):
        newsloom.sentiment_stats(warehouse, " ")


def test_sizes_and_remainder(warehouse):
    assert [tuple(r) for r in newsloom.category_stats(warehouse, "dog cat", size=1).collect()] == [("c0", 8)]
    assert newsloom.category_remainder(warehouse, "dog cat", size=1).first().sum_other_doc_count == 4
    assert tuple(newsloom.significant_sizes(warehouse, "cat").first()) == (8, 24)
    assert tuple(newsloom.significant_sizes(warehouse, "!!!").first()) == (0, 24)


def test_published_stats_do_not_read_the_text(warehouse):
    plan = newsloom.category_stats(warehouse, "dog")._jdf.queryExecution().executedPlan().toString()
    assert ("short_description:string" in plan) != warehouse.has_terms(warehouse.published())


def test_appended_rows_are_found(warehouse, lexicon, tmp_path):
    folder = tmp_path / "more"
    folder.mkdir()
    row = dict.fromkeys(RAW_FIELDS, "x") | {"short_description": "walrus", "date": "2018-05-27"}
    (folder / "a.json").write_text(json.dumps(row))
    newsloom.follow_files(warehouse, lexicon, str(folder), str(tmp_path / "checkpoint")).awaitTermination()
    hits = newsloom.fulltext_search(warehouse, "walrus").collect()
    assert [(h.short_description, h.date) for h in hits] == [("walrus", "2018-05-27")]


def test_date_filter_reaches_the_scan(warehouse):
    from newsloom.operators.match import match

    plan = match(warehouse.scan(), "2018-05", "date")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date_ts,2018-05-01" in plan and "LessThan(date_ts,2018-06-01" in plan
