import hashlib
import random
import re
import string

import duckdb
import pyarrow as pa
import pytest

from newsloom.llm import personal
from newsloom.llm.statements import ORACLES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def base_by_hand(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def card(rnd, n=16):
    body = "".join(rnd.choice(string.digits) for _ in range(n - 1))
    return next(body + c for c in string.digits if luhn(body + c))


def iban(country, account):
    for check in range(2, 99):
        whole = f"{country}{check:02d}{account}"
        if personal.remainder_97(whole) == 1:
            return whole
    raise AssertionError


def odd_texts():
    rnd = random.Random(6)
    pieces = [
        "a@b.c@d.e", "x@y@z.w", "me@host", "@no.one", "a..b%+@-.-", "é@x.yz ", "first.last@sub.example.org.", "1.2.3.4.5.6.7.8",
        "256.1.1.1", "0000255.0.0.007", "1.2.3", "1..2.3.4", "+12345678", "+1 (2)3", "+1234567", "+49 30 123456-78 ", "+1-2-", "++44 20 7946 0958",
        "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111 1111  1111 1111", "1-2", "7", "-", " ", "\n", "é", "😀", "+", "(", "a", "9" * 19,
    ]
    out = list(pieces)
    for _ in range(400):
        out.append("".join(rnd.choice([*pieces, card(rnd), card(rnd, 19)]) + rnd.choice(["", " ", "."]) for _ in range(rnd.randint(1, 6))))
    return out


ADDED = [
    ("my IBAN is GB82 WEST 1234 5698 7654 32 now", "GB82 WEST 1234 5698 7654 32", "iban"),
    ("paid from DE89370400440532013000.", "DE89370400440532013000", "iban"),
    ("paid from DE88370400440532013000.", None, None),
    ("sample DE89370400440532013000 here", None, None),
    ("her social security number 123-45-6789", "123-45-6789", "ssn"),
    ("part number 123-45-6789", None, None),
    ("SSN 000-45-6789, SSN 912-45-6789", None, None),
    ("call (555) 123-4567 today", "(555) 123-4567", "local"),
    ("Tel. 555-123-4567", "555-123-4567", "local"),
    ("hotel 555-123-4567", None, None),
    ("call +1 555-123-4567", "+1 555-123-4567", "phone"),
    ("order 555-123-4567, call", None, None),
]


def test_base_spans_are_those_of_the_patterns():
    for text in [*odd_texts(), *[t for t, _, _ in ADDED]]:
        found = [(s.kind, s.start, s.end) for s in personal.spans_of(text) if s.is_base]
        assert found == base_by_hand(text), text


@pytest.mark.parametrize("text, found, kind", ADDED)
def test_checksums_and_words_decide_on_added_kinds(text, found, kind):
    spans = personal.spans_of(text)
    assert [(text[s.start : s.end], s.kind) for s in spans] == ([(found, kind)] if found else [])


def test_scores_follow_the_words_nearby():
    scores = [personal.spans_of(t)[0].score for t in ("1.2.3.4", "server 1.2.3.4", "version 1.2.3.4", "observer 1.2.3.4")]
    assert scores == [60, 80, 30, 60]
    far = "card " + "x" * 36 + " 4111111111111111"
    assert personal.spans_of(far)[0].score == 80 and personal.spans_of(far[1:])[0].score == 80
    assert personal.spans_of("card " + "x" * 30 + " 4111111111111111")[0].score == 100


def test_made_accounts_are_found_and_changed_ones_are_not():
    rnd = random.Random(9)
    for _ in range(100):
        whole = iban("DE", "".join(rnd.choice(string.digits) for _ in range(18)))
        assert [s.kind for s in personal.spans_of(f"to {whole}!")] == ["iban"]
        at = rnd.randrange(4, 22)
        changed = whole[:at] + str((int(whole[at]) + 1 + rnd.randrange(8)) % 10) + whole[at + 1 :]
        assert "iban" not in [s.kind for s in personal.spans_of(f"to {changed}!")]


def test_long_texts_take_time_in_proportion():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1" * 500_000, "a@" * 500_000, "A1" * 500_000):
        assert isinstance(personal.spans_of(text), list)


@pytest.fixture(scope="module")
def rows(odd_rows):
    texts = [*odd_texts(), *[t for t, _, _ in ADDED], "x" * 300 + " mail me: joe@example.com " + "y" * 300]
    return [*odd_rows, *[(100 + k, t) for k, t in enumerate(texts)]]


def test_query_is_that_by_hand(make_docs, rows, no_docs):
    found = personal.scan(make_docs(rows, clashing=True)).collect()
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found)
    expected = []
    for i, text in rows:
        spans = base_by_hand(text)
        counts = [sum(k == kind for k, _, _ in spans) for kind in personal.BASE_KINDS]
        expected.append((str(i), *counts, hashlib.sha256(shown(spans).encode()).hexdigest()))
    assert got == sorted(expected)
    assert personal.scan(no_docs).count() == 0


def test_like_the_statement(make_docs, rows):
    # The statement's engine keeps no NUL characters.
    plain = [(i, t and t.replace("\x00", " ")) for i, t in rows]
    documents = pa.table({"doc_id": pa.array([i for i, _ in plain], pa.int64()), "text": pa.array([t for _, t in plain])})
    connection = duckdb.connect()
    connection.register("documents", documents)
    cursor = connection.execute(ORACLES["op12_personal"])
    names = [c[0] for c in cursor.description]
    found = personal.scan(make_docs(plain))
    assert sorted(names) == sorted(found.columns)
    expected = sorted(tuple(str(dict(zip(names, r))[c]) for c in found.columns) for r in cursor.fetchall())
    assert sorted(tuple(map(str, r)) for r in found.collect()) == expected


def test_redaction_keeps_rows_and_columns(make_docs):
    docs = make_docs([(1, "mail joe@x.org or +1 555-123-4567"), (2, None), (3, ""), (3, "")], clashing=True)
    clean = personal.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, str(r.text), r.spans) for r in clean.collect()) == [
        (1, "mail <email> or <phone>", "own spans"), (2, "None", "own spans"), (3, "", "own spans"), (3, "", "own spans"),
    ]


def test_overlapping_spans_are_one_mark():
    text = "+4111 1111 1111 111"
    spans = [personal.Span("card", 1, 19, 80), personal.Span("phone", 0, 19, 60)]
    assert personal.masked(text, spans) == "<phone>"
    assert personal.masked("ab", [personal.Span("ip", 0, 1, 1), personal.Span("email", 0, 2, 1)]) == "<email>"
