import re
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import common, quality_classifier, quality_rules, statistics, trees

from .conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    repeated = {p + k for found in places.values() if len(found) > 1 for p in found for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated))


@pytest.fixture(scope="module")
def lots(make_docs, make_labels):
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        text = sentence(i, 60 + i % 40)
        rows.append((i, text.replace(" ", "*** ") if bad else text))
        labels.append((i, int(not bad), 0))
    labels += [(None, 1, 0), (3, None, None), (5, 0, 0), (999, 1, 1)]
    return make_docs(rows, clashing=True), make_labels(labels)


def test_counts_are_those_by_hand(odd_docs, odd_rows, make_labels):
    extra = [(100, "a b c d e f g h " * 3), (101, "l 1\nl 1\n\nl 1\nl 1 \nx"), (102, "#*$ %&|<> x")]
    forest = quality_rules.fit(odd_docs, make_labels([]))
    found = quality_rules.judge(odd_docs, forest).collect()
    expected = sorted((str(i), *by_hand(t)) for i, t in odd_rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expected
    for row in found:
        assert row.base_failed == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)
        assert not (row.base_failed and row.kept) and row.score == 0.5
    for _, text in extra:
        data = np.frombuffer(text.encode(), np.uint8)
        base, _ = statistics.measure(data, np.array([0, len(data)]))
        assert tuple(int(base[name][0]) for name in statistics.BASE) == by_hand(text)


def test_rules_learn_and_keep(lots):
    docs, labels = lots
    forest = quality_rules.fit(docs, labels)
    rows = {r.doc_id: r for r in quality_rules.judge(docs, forest).collect()}
    assert len(rows) == 240
    assert all(rows[i].kept == (i % 3 != 0) for i in rows)
    kept = quality_rules.keep(docs, forest)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(240) if i % 3]
    assert kept.first()["kept"] == "own kept"
    again = quality_rules.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(forest.value, again.value)


def test_classifier_learns_from_the_training_fold_alone(lots):
    docs, labels = lots
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert 20 < len(held) < 120 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.doc_id % 3 != 0) == int(r.score >= 0.7) for r in held)
    flipped = labels.select(
        "doc_id", (common.is_held_out("doc_id", 4, 2).cast("int") + labels.quality * 0).alias("quality"), "toxic"
    )
    only_held = flipped.where(common.is_held_out("doc_id", 4, 2))
    assert len(quality_classifier.fit(docs, only_held).feature) == 0


@pytest.mark.parametrize("module", [quality_rules.judge, quality_classifier.score])
def test_odd_tables(module, odd_docs, odd_rows, no_docs, make_labels):
    forest = quality_classifier.fit(no_docs, make_labels([]))
    assert module(no_docs, forest).collect() == []
    assert module(odd_docs, forest).count() == len(odd_rows)
    assert quality_rules.keep(no_docs, forest).columns == no_docs.columns


def test_trees_fit_and_respect_directions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + 0.3 * rng.normal(size=2000) > 0).astype(float)
    forest = trees.fit(x, y, monotone=[1, 0, -1, 0])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9
    for feature, sign in ((0, 1), (2, -1)):
        ramp = np.repeat(rng.normal(size=(50, 4)), 60, axis=0)
        ramp[:, feature] = np.tile(np.linspace(-4, 4, 60), 50)
        steps = np.diff(forest.score(ramp).reshape(50, 60), axis=1)
        assert (sign * steps >= -1e-12).all()
    free = trees.fit(x, y)
    assert ((free.score(x) > 0.5) == y).mean() >= 0.9


def test_flat_trees_score_like_a_walk():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 3)), (rng.random(300) > 0.5).astype(float)
    forest = trees.fit(x, y, trees=5, depth=3)

    def walk(row):
        total = forest.bias
        for t in range(len(forest.feature)):
            node = 0
            while forest.left[t, node] != node:
                goes_left = row[forest.feature[t, node]] <= forest.threshold[t, node]
                node = (forest.left if goes_left else forest.right)[t, node]
            total += forest.value[t, node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(row) for row in x])


def test_an_id_of_many_rows_does_not_fill_the_sample(make_docs, make_labels):
    from pyspark.sql import functions as F

    from newsloom.llm import common, quality

    labels = make_labels([(i, i % 2, 0) for i in range(200)])
    ids = sorted(r.doc_id for r in common.labelled(labels, "quality").collect())
    first, others = ids[0], ids[1:]
    single = [(i, sentence(i, 20 + i)) for i in others]
    for many, least in (([sentence(7, 30)] * 300, len(ids)), ([sentence(k, 30 + k) for k in range(300)], 30)):
        docs = make_docs([(first, t) for t in many] + single)
        x, y = quality.training_rows(docs, labels, "quality", 200)
        assert len(x) == min(200, len(set(many)) + len(others))
        assert (y != first % 2).sum() >= least // 3
    sample = common.row_sample(docs, F.struct("lang", "text"), 200).collect()
    assert len(sample) == 200 and sum(r.doc_id != first for r in sample) >= 30
    assert [r.doc_id for r in sample] == sorted(r.doc_id for r in sample)
