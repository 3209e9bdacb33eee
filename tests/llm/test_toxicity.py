import numpy as np
import pytest

from newsloom.llm import toxicity

from .conftest import sentence


@pytest.fixture(scope="module")
def lots(make_docs, make_labels):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = sentence(i, 30 + i % 30)
        if bad:
            words = text.split()
            words[i % 20] = "vile" + "abcdefgh"[i % 8]
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    return make_docs(rows, clashing=True), make_labels(labels + [(None, 1, 1), (4, None, None)])


def test_held_out_documents(lots):
    docs, labels = lots
    model = toxicity.fit(docs, labels)
    rows = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    right = [(r.score >= 0.3) == (r.doc_id % 4 == 0) for r in rows]
    assert len(rows) > 60 and np.mean(right) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert set(model.thresholds) == {"en"}
    again = toxicity.fit(docs.repartition(5), labels)
    assert np.array_equal(again.network.weights, model.network.weights)


def test_odd_tables(odd_docs, odd_rows, no_docs, make_labels):
    model = toxicity.fit(no_docs, make_labels([]))
    assert toxicity.score(no_docs, model).collect() == []
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and {r.score for r in rows} == {0.5}
    one_class = toxicity.fit(odd_docs, make_labels([(i, 0, 0) for i in range(1, 12)]))
    assert all(r.score < 0.05 for r in toxicity.score(odd_docs, one_class).collect())


def test_windows_do_not_cross_texts():
    net = toxicity.new_network()
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, toxicity.BUCKETS, (n, toxicity.PARTS)) for n in (5, 0, 1, 2, 9)]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    together = net.score(np.concatenate(texts), offsets)
    alone = [net.score(t, np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)


def test_long_texts_are_taken_in_parts(monkeypatch):
    net = toxicity.new_network()
    words = np.random.default_rng(1).integers(1, toxicity.BUCKETS, (1000, toxicity.PARTS))
    whole = net.score(words, np.array([0, 1000]))
    for size in (1, 7, 333, 999):
        monkeypatch.setattr(toxicity, "LONG", size)
        assert np.allclose(net.score(words, np.array([0, 1000])), whole, atol=1e-6)


def test_thresholds_divide_best():
    scores = np.array([0.1, 0.2, 0.6, 0.7, 0.9])
    assert toxicity.best_threshold(scores, np.array([0, 0, 1, 1, 1.0]), 0.3) == pytest.approx(0.4)
    assert toxicity.best_threshold(scores, np.zeros(5), 0.3) == 0.3
    assert toxicity.best_threshold(np.zeros(0), np.zeros(0), 0.3) == 0.3


def test_scores_are_those_of_a_plain_loop():
    net = toxicity.new_network()
    words = np.random.default_rng(3).integers(1, toxicity.BUCKETS, (40, toxicity.PARTS))
    vectors = [sum(net.embedding[b].astype(float) for b in word) for word in words] + [np.zeros(toxicity.DIMENSION)] * 2
    raw, at = net.bias, 0
    for kernel, bias in zip(net.filters, net.biases):
        for f in range(toxicity.FILTERS):
            best = -np.inf
            for i in range(len(words)):
                z = float(bias[f])
                for k in range(len(kernel)):
                    z += sum(vectors[i + k][d] * float(kernel[k][d][f]) for d in range(toxicity.DIMENSION))
                best = max(best, z)
            raw += max(best, 0.0) * float(net.weights[at])
            at += 1
    assert net.score(words, np.array([0, 40]))[0] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-5)


def test_long_texts_teach_as_whole_ones_do(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, toxicity.BUCKETS, (n, toxicity.PARTS)).astype(np.int32) for n in rng.integers(1, 300, 60)]
    y = (np.arange(60) % 3 == 0).astype(float)
    for text in np.flatnonzero(y):
        texts[text][rng.integers(0, len(texts[text]))] = 77
    whole = toxicity.train(texts, y, visits=300)
    for size, part in ((20, 1 << 17), (20, 7), (0, 50)):
        monkeypatch.setattr(toxicity, "LONG_TRAINING", size)
        monkeypatch.setattr(toxicity, "LONG", part)
        in_parts = toxicity.train(texts, y, visits=300)
        assert np.allclose(in_parts.weights, whole.weights, atol=1e-3)
        assert np.allclose(in_parts.embedding, whole.embedding, atol=1e-3)


def test_long_documents_are_in_the_sample_and_it_is_bounded(make_docs, make_labels, monkeypatch):
    rows = [(i, sentence(i, 10_000 if i % 2 else 40)) for i in range(60)]
    labels = make_labels([(i, 1, i % 2) for i in range(60)])
    train, learnt = toxicity.train, []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: learnt.append(texts) or train(texts, y, visits=60))
    docs = make_docs(rows + rows[:5])
    toxicity.fit(docs, labels)
    sizes = sorted(map(len, learnt[0]))
    assert sizes[0] == 40 and sizes[-1] == 10_000 and 15 < sum(n == 10_000 for n in sizes) < 30
    again = toxicity.fit(docs.repartition(7), labels)
    assert [t.tolist() for t in learnt[1]] == [t.tolist() for t in learnt[0]] and again.thresholds
    toxicity.fit(docs, labels, max_words=50_000)
    assert 10_000 <= sum(map(len, learnt[2])) <= 50_000
    toxicity.fit(docs, labels, max_words=1)
    assert len(learnt[3]) == 0  # the one text sets the threshold


def test_documents_outside_the_sample_are_learnt_from(make_docs, make_labels):
    # What tells the classes apart is in all texts, but the sample holds few of them.
    rows = [(i, sentence(i, 20) + (" vile" + "abcdefgh"[i % 8] if i % 4 == 0 else "")) for i in range(1200)]
    docs, labels = make_docs(rows), make_labels([(i, 1, int(i % 4 == 0)) for i in range(1200)])
    model = toxicity.fit(docs, labels, max_rows=40)
    held = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert np.mean([r.toxic == (r.doc_id % 4 == 0) for r in held]) > 0.95
    again = toxicity.fit(docs.repartition(5), labels, max_rows=40)
    assert np.array_equal(again.network.weights, model.network.weights) and again.thresholds == model.thresholds


def test_thresholds_of_counts_are_those_of_the_rows():
    rng = np.random.default_rng(4)
    scores, y = rng.integers(0, 20, 300) / 20, (rng.random(300) < 0.4).astype(float)
    steps = np.unique(scores)
    n = np.array([(scores == s).sum() for s in steps], float)
    hits = np.array([y[scores == s].sum() for s in steps])
    assert toxicity.threshold_of_counts(steps, n, hits, 0.3) == toxicity.best_threshold(scores, y, 0.3)


def test_the_driver_gets_no_more_of_more_learners(spark, make_docs, make_labels, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, i, i % 2, rng.integers(1, toxicity.BUCKETS, 60).tolist()) for i in range(64)]
    learnt_from = spark.createDataFrame(rows, "doc_id long, content long, label int, words array<smallint>")
    collect, sizes = type(learnt_from).collect, []

    def measured(df):
        found = collect(df)
        sizes.append(sum(len(value) for row in found for value in row if isinstance(value, (bytes, bytearray))))
        return found

    monkeypatch.setattr(type(learnt_from), "collect", measured)
    start = toxicity.new_network()
    one, many = (toxicity.learnt_on(start, learnt_from, learners) for learners in (1, 8))
    assert sizes[0] == sizes[1] > 0
    again = toxicity.learnt_on(start, learnt_from.repartition(3), 8)
    assert np.array_equal(again.embedding, many.embedding) and not np.array_equal(one.embedding, many.embedding)
    # One learner's mean is its own change.
    trainer = toxicity.Trainer(toxicity.new_network())
    order = [row.doc_id for row in collect(learnt_from.selectExpr("doc_id", "xxhash64(doc_id, content) AS h").orderBy("h"))]
    texts = [np.array(rows[i][3]).reshape(-1, toxicity.PARTS) for i in order]
    own = trainer.learn(texts, np.array([rows[i][2] for i in order], float), toxicity.PASSES)
    assert np.allclose(one.embedding, own.embedding, atol=1e-6) and np.allclose(one.weights, own.weights, atol=1e-6)
