import hashlib
import random
import re

import pytest

from newsloom.llm import decontaminate

from .conftest import sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def by_hand(text, items):
    mine, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        size = min(len(w), 10)
        for k in range(len(w) - size + 1) if w else []:
            for i in range(len(mine) - size + 1):
                if mine[i : i + size] == w[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(mine), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def cases(odd_rows):
    rnd = random.Random(2)
    items = [(i, sentence(100 + i, 12 + i)) for i in range(6)]
    items += [(6, "Short one"), (7, "naïve"), (8, "three little words"), (9, None), (10, " .,! "), (3, sentence(103, 15))]
    items += [(11, "a a a a a a a a a a a a"), (12, sentence(100, 40))]
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 20_000]
    for k in range(60):
        parts = [sentence(k, 15)]
        _, text = items[k % 6]
        w = text.split()
        cut = rnd.randint(0, len(w) - 10)
        parts.append(" ".join(w[cut : cut + rnd.choice([9, 10, 11, 30])]).upper() if k % 2 else text)
        parts.append(rnd.choice(["short, ONE!", "NAÏVE naïve", "three  little\nwords", "a " * rnd.randint(8, 25), ""]))
        rnd.shuffle(parts)
        rows.append((1000 + k, rnd.choice([" ", "... "]).join(parts)))
    return rows, items


def test_like_all_windows(spark, make_docs, cases):
    rows, items = cases
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.judge(make_docs(rows, clashing=True), table).collect()
    got = sorted(
        (str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found
    )
    assert got == sorted((str(i), *by_hand(t, items)) for i, t in rows)
    assert sum(r.contaminated for r in found) > 30


def test_large_benchmarks_are_joined_by_shuffle(spark, make_docs, cases, monkeypatch):
    rows, items = cases
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make_docs(rows)
    expected = sorted(map(str, decontaminate.judge(docs, table).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert sorted(map(str, decontaminate.judge(docs, table).collect())) == expected


@pytest.mark.parametrize("block", [1, 7])
def test_windows_across_blocks(spark, make_docs, cases, monkeypatch, block):
    rows, items = cases
    table = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    got = decontaminate.judge(make_docs(rows), table).collect()
    found = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert found == sorted((str(i), *by_hand(t, items)) for i, t in rows)


def test_only_the_rarest_shingles_are_joined(spark, make_docs):
    """A window is looked for by one shingle, the one that documents hold least often."""
    item = "of the one and of the two and of the"
    docs = make_docs([(1, item), (2, "of the sea and of the sky"), (3, "and of the end")])
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    parts = decontaminate._window_shingles(decontaminate.benchmark_windows(items), 3)
    counts = {r.h: r.n for r in decontaminate._counts(docs, parts, [3], 10).collect()}
    n = {r.offset: counts[r.h] for r in parts.collect()}
    assert [n[k] for k in range(8)] == [1, 1, 1, 4, 1, 1, 1, 4]
    (hit,) = decontaminate._hits(docs, items, 10, 3).collect()
    assert (hit.start, hit.size, hit["items"]) == (0, 10, ["1"])


def test_clean_documents_stay(spark, make_docs, cases):
    rows, items = cases
    docs = make_docs(rows, clashing=True)
    left = decontaminate.clean(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert left.columns == docs.columns
    kept = left.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted(
        (str(i), str(t)) for i, t in rows if not by_hand(t, items)[4]
    )
    assert kept[0]["_hash"] == "own _hash"


def test_odd_tables(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "one"), (None, "one")], "item_id bigint, text string")
    assert decontaminate.judge(no_docs, some).collect() == []
    rows = decontaminate.judge(odd_docs, none).collect()
    assert len(rows) == len(odd_rows) and not any(r.contaminated for r in rows)
    assert decontaminate.clean(odd_docs, none).count() == len(odd_rows)
    assert [r.doc_id for r in decontaminate.judge(odd_docs, some).where("contaminated").collect()] == [4]


def test_only_native_functions(spark, odd_docs):
    items = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    plan = decontaminate.judge(odd_docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn|Cartesian", plan)
