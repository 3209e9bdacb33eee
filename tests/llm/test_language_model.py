import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import common, language_model as lm
from newsloom.llm import octets

from .conftest import sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.fixture(scope="module")
def rows(odd_rows):
    """Texts whose words follow each other by rule, which a unigram model cannot know."""
    out = [(i, t) for i, t in odd_rows if t is None or len(t) < 20_000]
    for k in range(300):
        words = []
        for j in range(40 + k % 20):
            words += [f"First{(k + j) % 9}", f"second{(k + j) % 9}", f"third{(k * j) % 31}"]
        out.append((1000 + k, " ".join(words) + " " + sentence(k, 3)))
    return out


@pytest.mark.parametrize("frequent", [500_000, 30])
def test_base_scores_are_those_by_hand(make_docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (frequent,))
    monkeypatch.setattr(lm, "HELD", 500)
    found = lm.learn_and_score(make_docs(rows, clashing=True)).collect()
    counts = Counter()
    for i, text in rows:
        if not held_out(i):
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, text in rows:
        mine = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in mine)
        expected.append((str(i), held_out(i), len(mine), sum(counts[t] > 0 for t in mine), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got) == sorted(expected)
    held = [r for r in found if r.held_out and r.n_tokens > 20]
    assert len(held) > 30
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)  # both are negative
    assert all(r.score < 0 for r in found)


def test_probabilities_add_up_to_one(make_docs, rows):
    docs = make_docs(rows)
    counts = common.stored(lm.count_tokens(docs), "counts")
    model = lm.fit(docs, counts)
    words = model.vocabulary
    tool = lm.Scorer(model)
    for before in ((0, 0), (lm.CLASSES, lm.CLASSES), (5, 900)):
        bounds = np.array([0, 3])
        total = 0.0
        for kind in range(lm.CLASSES):
            # The third token of a text with this context.
            kinds = np.array([before[1] % lm.CLASSES, before[0] % lm.CLASSES, kind])
            total += math.exp(tool.log_probabilities(kinds, bounds)[2])
        assert total == pytest.approx(1, abs=1e-3)
    assert words.total == sum(len(tokens(t)) for _, t in rows)
    assert int(words.class_distinct.sum()) == words.distinct == counts.count()
    # Inside a shared class: all its tokens, and one unseen.
    per_class = Counter()
    for row in counts.collect():
        kind = int(words.look_up(np.array([row.token], np.int64).view(np.uint64), np.array([row.shared]))[0][0])
        if kind >= lm.CLASSES - lm.SHARED:
            per_class[kind] += (row.n + 0.5) / (words.class_total[kind] + 0.5 * (words.class_distinct[kind] + 1))
    for kind, share in per_class.items():
        unseen = 0.5 / (words.class_total[kind] + 0.5 * (words.class_distinct[kind] + 1))
        assert share + unseen == pytest.approx(1)


def test_counts_merge_and_bounds_hold(make_docs, rows, monkeypatch):
    docs = make_docs(rows)
    whole = {r.token: r.n for r in lm.count_tokens(docs).collect()}
    monkeypatch.setattr(lm, "HELD", 50)
    assert {r.token: r.n for r in lm.count_tokens(docs.repartition(3)).collect()} == whole
    counts = common.stored(lm.count_tokens(docs), "counts")
    for bound in (0, 1, 7, 60):
        words = lm.vocabulary(counts, bound)
        assert len(words.token) <= bound + 1 and lm.END in words.token
        assert {int(t): n for t, n in zip(words.token.view(np.int64), words.count)} == {
            t: n for t, n in whole.items() if n >= words.least or t == int(lm.END.view(np.int64))
        }


def test_odd_tables(odd_docs, odd_rows, no_docs, make_docs):
    assert lm.learn_and_score(no_docs).collect() == []
    rows = lm.learn_and_score(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    only_held = [(i, "some words") for i in range(50) if held_out(i)]
    alone = lm.learn_and_score(make_docs(only_held)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 and r.score < 0 for r in alone)


def test_hashes_tell_words_apart():
    words = [f"{a}{b}{c}".encode() for a in "abxyz" for b in range(200) for c in ("", "a", "aa", "\0", "é")]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    hashes = octets.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    again = octets.span_hashes(data[starts[-1] :], np.array([0]), np.array([len(words[-1])]))
    assert again[0] == hashes[-1]


def test_every_position_teaches_the_model(make_docs, rows, monkeypatch):
    """Contexts by hand; learners get all of them, in however many parts."""
    docs = make_docs(rows)
    words = lm.vocabulary(common.stored(lm.count_tokens(docs), "counts"))
    monkeypatch.setattr(lm, "HELD", 500)
    found = common.stored(lm.count_contexts(docs.repartition(3), words), "contexts")
    whole = {r.code: r.n for r in found.collect()}
    kinds = {}
    for token, kind in zip(words.token, words.kind):
        kinds[int(token)] = int(kind)
    expected = Counter()
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        before = [lm.CLASSES] * 2
        for token in lm.tokens(data, np.array([0, len(data)]))[0]:
            kind = kinds[int(token)]
            expected[(kind * (lm.CLASSES + 1) + before[0]) * (lm.CLASSES + 1) + before[1]] += 1
            before = [kind, before[0]]
    assert whole == expected and sum(whole.values()) == words.total
    for size in (100, 1000, 10**9):
        dealt, learners, most = lm.deal(found, size)
        again, weights = Counter(), Counter()
        for r in dealt.collect():
            assert r.n > 0 and r.learner < learners
            again[r.code] += r.n
            weights[r.learner] += r.n
        assert again == expected and most == math.ceil(words.total / (learners * size))
        assert max(weights.values()) < 2 * words.total / learners + 50 * most


def test_learners_together_learn_the_rule(make_docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "LEARNER_ROWS", 800)
    found = lm.learn_and_score(make_docs(rows)).collect()
    held = [r for r in found if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    again = lm.learn_and_score(make_docs(rows).repartition(5)).collect()
    assert sorted(str((r.doc_id, r.score)) for r in again) == sorted(str((r.doc_id, r.score)) for r in found)


def small_model(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1, (lm.CLASSES + 1, lm.DIMENSION)).astype(np.float32)
    maps = [rng.normal(0, 0.5, (lm.DIMENSION, lm.DIMENSION)).astype(np.float32) for _ in range(lm.CONTEXT)]
    targets = rng.normal(0, 0.3, (lm.CLASSES, lm.DIMENSION)).astype(np.float32)
    return lm.Model(None, vectors, maps, targets, rng.normal(0, 1, lm.CLASSES).astype(np.float32))


def test_scores_do_not_depend_on_what_is_scored_with_them():
    model, rng = small_model(4), np.random.default_rng(5)
    texts = [rng.integers(0, lm.CLASSES, n) for n in [1, 2, 3, 700, 5, 4000, 40, 1, 9]]

    def scored(order, together):
        out, tool = {}, lm.Scorer(model)
        for at in range(0, len(order), together):
            some = order[at : at + together]
            bounds = np.append(0, np.cumsum([len(texts[i]) for i in some]))
            found = tool.log_probabilities(np.concatenate([texts[i] for i in some]), bounds)
            out |= {i: found[a:b].tolist() for i, a, b in zip(some, bounds, bounds[1:])}
        return out

    whole = scored(list(range(9)), 9)
    for together in (1, 2, 4):
        assert scored(list(range(9)), together) == whole
        assert scored(list(range(8, -1, -1)), together) == whole


def test_scores_are_those_of_a_plain_loop():
    model, rng = small_model(6), np.random.default_rng(7)
    kinds = rng.integers(0, lm.CLASSES, 40)
    found = lm.Scorer(model).log_probabilities(kinds, np.array([0, 25, 40]))
    vectors, targets = model.vectors.astype(float), model.targets.astype(float)
    for first, last in ((0, 25), (25, 40)):
        for i in range(first, last):
            predicted = [0.0] * lm.DIMENSION
            for k in range(lm.CONTEXT):
                before = kinds[i - 1 - k] if i - 1 - k >= first else lm.CLASSES
                for d in range(lm.DIMENSION):
                    predicted[d] += sum(vectors[before][e] * float(model.maps[k][e][d]) for e in range(lm.DIMENSION))
            scores = [sum(p * t for p, t in zip(predicted, target)) + float(b) for target, b in zip(targets, model.bias)]
            top = max(scores)
            expected = scores[kinds[i]] - top - math.log(sum(math.exp(s - top) for s in scores))
            assert found[i] == pytest.approx(expected, abs=1e-4)
