import hashlib
import random
import zlib

import pytest

from newsloom.llm import periodic_runs as pr

BLANKS = " \t\n\r\x0b\x0c"


def words_of(text):
    for blank in BLANKS:
        text = (text or "").replace(blank, " ")
    return [w for w in text.split(" ") if w]


def by_hand(words, min_length=6, exponent=4):
    """Every stretch of every period, widened word by word."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def random_words(rnd):
    letters = rnd.choice([1, 2, 2, 3, 5])
    words = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randint(0, 60))]
    if words and rnd.random() < 0.6:
        first, period = rnd.randrange(len(words)), rnd.randint(1, 8)
        words[first:] = (words[first : first + period] * len(words))[: len(words) - first]
    return words + words[: rnd.randint(0, 30)] * rnd.choice([0, 1, 4, 6])


@pytest.mark.parametrize("min_length, exponent", [(6, 4), (2, 3), (8, 3), (10, 5)])
def test_runs_are_those_by_hand(min_length, exponent):
    rnd = random.Random(min_length * exponent)
    for _ in range(400):
        texts = [random_words(rnd) for _ in range(rnd.randint(1, 4))]
        expected = [by_hand(words, min_length, exponent) for words in texts]
        assert pr.runs_of_texts(texts, min_length, exponent) == expected


def test_refused_limits():
    with pytest.raises(ValueError):
        pr.runs_of_texts([[b"a"] * 9], exponent=2)


def test_long_texts_of_few_words():
    rnd = random.Random(1)
    assert pr.runs_of_texts([[b"a"] * 200_000, [b"a", b"b"] * 50_000]) == [[(0, 200_000, 1)], [(0, 100_000, 2)]]
    lines = [[b"x", b"y", b"z", b"u"], [b"x", b"y", b"z", b"v"]]
    words = [w for _ in range(600) for w in rnd.choice(lines)]
    assert pr.runs_of_texts([words]) == [by_hand(words)]


def expected_row(doc_id, text):
    words = words_of(text)
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_hand(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (
        str(doc_id), len(runs), *best, runs and best[1] * 1000 // best[2] or None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def rows_of(df):
    return sorted(
        (str(r.doc_id), r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        for r in df.collect()
    )


def text_rows():
    rnd = random.Random(4)
    out = []
    for k in range(300):
        words = [w.decode() for w in random_words(rnd)]
        out.append((k, "".join(w + rnd.choice([" ", "  ", "\n", "\t", "\x0b\x0c "]) for w in words)))
    return out + [(900, "é é é é é é   x x \x1c \x1c \x1c \x1c \x1c \x1c"), (901, "a " * 5), (902, "a " * 6)]


def test_query_is_that_by_hand(make_docs, odd_rows):
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 30_000] + text_rows()
    expected = sorted(expected_row(i, t) for i, t in rows)
    assert rows_of(pr.digests(make_docs(rows, clashing=True))) == expected
    assert rows_of(pr.digests(make_docs(rows).repartition(3))) == expected


def test_whole_long_texts_and_empty_tables(odd_docs, odd_rows, no_docs):
    found = pr.digests(odd_docs)
    assert found.count() == len(odd_rows) and pr.digests(no_docs).count() == 0
    assert pr.digests(no_docs).columns == found.columns


def test_own_interface(make_docs, odd_docs):
    docs = make_docs([(1, "so so so so so so it goes"), (2, None), (3, "a b a b a b a b c")])
    runs = {r.doc_id: [tuple(run) for run in r.runs] for r in pr.find_runs(docs).collect()}
    assert runs == {1: [(0, 6, 1)], 2: [], 3: [(0, 8, 2)]}
    assert {r.doc_id: r.collapsed for r in pr.collapse(docs).collect()} == {1: "so it goes", 2: "", 3: "a b c"}
    assert pr.find_runs(odd_docs.withColumnRenamed("text", "body"), text="body").count() == odd_docs.count()
