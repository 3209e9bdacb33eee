import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import anchors, substrings, suffixes

from .conftest import sentence


def by_hand(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    met = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        inside = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if met[b[k : k + length]] > 1:
                inside[k : k + length] = True
        kept = bytes(x for x, gone in zip(b, inside) if not gone)
        spans = int((inside[:-1] & ~np.append(False, inside[:-2])).sum()) if len(b) else 0
        out.append((str(i), len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs, length):
    rows = substrings.remove(docs, length).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a passage in many surroundings, periodic texts, edges."""
    rnd = random.Random(6)
    passage = sentence(77, 40)
    out = [(k, sentence(k, 120)) for k in range(10)]
    out += [(100 + k, out[k % 3][1]) for k in range(6)]
    for k in range(30):
        words = out[k % 5][1].split()
        words[rnd.randrange(len(words))] = f"other{k}"
        out.append((200 + k, " ".join(words)))
    out += [(300 + k, sentence(300 + k, rnd.randint(0, 9)) + passage + sentence(400 + k, 5)) for k in range(40)]
    out += [(500, "ab" * 700), (501, "x" * 399), (502, "x" * 400), (503, "x" * 401 + "y"), (504, "é" * 500)]
    out += [(505, passage[:150] + "|" + passage[:150]), (506, None), (507, ""), (None, passage), (None, passage)]
    return out


@pytest.mark.parametrize("length, contexts", [(400, 1024), (100, 1024), (100, 2), (64, 5)])
def test_like_all_strings(make_docs, rows, monkeypatch, length, contexts):
    monkeypatch.setattr(substrings, "CONTEXTS", contexts)
    assert found(make_docs(rows, clashing=True), length) == by_hand(rows, length)


def test_a_passage_in_very_many_texts(make_docs, monkeypatch):
    """With the limits as they are, and with most contexts joined as very frequent ones."""
    passage = sentence(78, 80)[:520]
    many = substrings.CONTEXTS + 200
    rows = [(k, f"{sentence(k, 8)} {passage} {sentence(k + many, 8)}") for k in range(many)]
    rows += [(many + k, rows[k % 2][1]) for k in range(40)]
    expected = by_hand(rows, substrings.LENGTH)
    assert found(make_docs(rows), substrings.LENGTH) == expected
    monkeypatch.setattr(substrings, "HOT_ROWS", 30)
    assert found(make_docs(rows), substrings.LENGTH) == expected


@pytest.mark.parametrize("hot", [1, 2])
def test_frequent_contexts_are_found_like_others(make_docs, rows, monkeypatch, hot):
    monkeypatch.setattr(substrings, "CONTEXTS", 2)
    monkeypatch.setattr(substrings, "HOT_ROWS", hot)
    assert found(make_docs(rows), 100) == by_hand(rows, 100)


def test_long_texts_are_read_in_segments(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 3_000)
    text = sentence(1, 3_000)
    rows = [(1, text + " " + text[5_000:9_000]), (2, sentence(2, 2_000)), (3, text[100:8_000])]
    assert found(make_docs(rows), 400) == by_hand(rows, 400)


def test_odd_tables(odd_docs, odd_rows, no_docs):
    assert found(no_docs, 400) == []
    rows = found(odd_docs, 400)
    assert len(rows) == len(odd_rows)
    assert dict((r[0], r[1:]) for r in rows)["8"][1] == 50_000  # one letter over and over


def test_cover_reaches_any_two_places():
    inside, shift = suffixes.difference_cover()
    assert inside.sum() <= 9
    for a in range(suffixes.COVER):
        for b in range(suffixes.COVER):
            k = shift[a, b]
            assert inside[(a + k) % suffixes.COVER] and inside[(b + k) % suffixes.COVER]


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffixes_are_sorted(letters):
    rnd = random.Random(letters)
    raw = bytes(97 + rnd.randrange(letters) for _ in range(1500))
    raw = raw[:700] + raw[:600] + raw[700:]
    text = np.frombuffer(raw, np.uint8)
    places = np.array(sorted(rnd.sample(range(len(raw) - 400), 400)))
    buckets = np.array([rnd.randrange(3) for _ in places])
    order = suffixes.sort_suffixes(text, places, buckets, 400)
    keys = [(buckets[i], raw[places[i] : places[i] + 400]) for i in order]
    assert keys == sorted(keys)


def test_equal_windows_share_a_bucket():
    rnd = random.Random(9)
    raw = bytearray(rnd.randrange(97, 101) for _ in range(6000))
    raw[4000:4900] = raw[1003:1903]
    data = np.frombuffer(bytes(raw), np.uint8)
    starts, owner = anchors.owners(data, np.array([0, len(data)]), 400)
    place = dict(zip(starts.tolist(), owner.tolist()))
    assert len(place) == len(raw) - 399
    for k in range(0, 501):
        assert place[4000 + k] - (4000 + k) == place[1003 + k] - (1003 + k)


def test_sliding_minimum():
    values = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 2, 7, 64, 500):
        expected = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert anchors.sliding_minimum(values, width).tolist() == expected
