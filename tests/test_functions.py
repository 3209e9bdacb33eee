import datetime as dt
import random

import pytest
import regex
from pyspark.sql import functions as F

from newsloom.functions import names
from newsloom.functions.dates import date_period, parse_date
from newsloom.functions.scores import significance, stored_length
from newsloom.functions.text import has_any_token, query_tokens, tokenise


def tokens(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    return list(frame.select(tokenise(F.col("text")).alias("t")).first().t)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Don't stop O'Neil's e-mail", ["don't", "stop", "o'neil's", "e", "mail"]),
        ("u.s.a 3.14 1,000 x:y l’été", ["u.s.a", "3.14", "1,000", "x:y", "l’été"]),
        ("3.a a.3 1,a a'1", ["3", "a", "a", "3", "1", "a", "a", "1"]),
        ("foo_bar _x_ ___ a_'b", ["foo_bar", "_x_", "a_", "b"]),
        ("AT&T; end. (paren) \"quoted\"", ["at", "t", "end", "paren", "quoted"]),
        ("日本 カタカナ ひら", ["日", "本", "カタカナ", "ひ", "ら"]),
        ("カタ_b_1 aカ カa _カ_", ["カタ_b_1", "a", "カ", "カ", "a", "_カ_"]),
        ("a😀b 👍🏽 👩‍💻", ["a", "😀", "b", "👍🏽", "👩‍💻"]),
        ("ÄÖÜ Straße naïve", ["äöü", "straße", "naïve"]),
        ("", []),
        ("!!! -- ...", []),
        ("a\nb\tc", ["a", "b", "c"]),
    ],
)
def test_tokens(spark, text, expected):
    assert tokens(spark, text) == expected


@pytest.mark.parametrize("alphabet", ["bbcZßЖ日ひ한12__''..,,;::  -’·@", "bcZß13__.,: カキ-日"])
def test_tokens_against_another_word_breaker(spark, alphabet):
    """Word boundaries of the ``regex`` module, which has rules of its own for vowels."""
    boundary = regex.compile(r"\b", flags=regex.WORD | regex.V1)
    chance = random.Random(7)
    texts = ["".join(chance.choices(alphabet, k=chance.randint(1, 14))) for _ in range(4000)]

    def expected(text):
        cuts = sorted({0, len(text), *(m.start() for m in boundary.finditer(text))})
        pieces = [text[i:j] for i, j in zip(cuts, cuts[1:])]
        return [p.lower() for p in pieces if regex.search(r"[\p{L}\p{Nd}]", p)]

    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in frame.select("text", tokenise(F.col("text")).alias("t")).collect():
        assert list(row.t) == expected(row.text), row.text


def test_long_tokens_are_cut(spark):
    assert [len(t) for t in tokens(spark, "x " + "y" * 600 + " z")] == [1, 255, 255, 90, 1]
    assert [len(t) for t in tokens(spark, "y" * 255)] == [255]


def test_hostile_text_neither_recurses_nor_backtracks(spark):
    text = "1." * 200_000 + " " + "_" * 200_000 + " " + "a'" * 200_000
    assert sum(len(t) for t in tokens(spark, text)) == 399_999 + 399_999


def test_query_tokens_keep_repetition(spark):
    assert query_tokens(spark, "The erst, THE!") == ["the", "erst", "the"]
    assert query_tokens(spark, "!!!") == []


def test_match_needs_whole_tokens(spark):
    frame = spark.createDataFrame([("other",), ("the other",), ("THE",), ("",)], "text string")
    hit = has_any_token(F.col("text"), ["the"])
    assert [r.hit for r in frame.select(hit.alias("hit")).collect()] == [False, True, True, False]


def test_match_with_many_words(spark):
    words = [f"w{i}" for i in range(40)]
    frame = spark.createDataFrame([("w39 x",), ("w3x",)], "text string")
    hit = has_any_token(F.col("text"), words)
    assert [r.hit for r in frame.select(hit.alias("hit")).collect()] == [True, False]


DATES = {
    "2018": dt.datetime(2018, 1, 1),
    "2018-05": dt.datetime(2018, 5, 1),
    "2018-05-26": dt.datetime(2018, 5, 26),
    "2018-05-26T10": dt.datetime(2018, 5, 26, 10),
    "2018-05-26T10:11": dt.datetime(2018, 5, 26, 10, 11),
    "2018-05-26T10:11:12.345Z": dt.datetime(2018, 5, 26, 10, 11, 12, 345000),
    "2018-05-26T10:11:12.345678": dt.datetime(2018, 5, 26, 10, 11, 12, 345000),
    "2018-05-26T10:11:12+02:00": dt.datetime(2018, 5, 26, 8, 11, 12),
    "2018-05-26T10:11:12-0230": dt.datetime(2018, 5, 26, 12, 41, 12),
    "2018-05-26T10+02": dt.datetime(2018, 5, 26, 8),
    "1527292800000": dt.datetime(2018, 5, 26),
    "123": dt.datetime(1970, 1, 1, 0, 0, 0, 123000),
    # Skipped by daylight saving in the session time zone, yet a moment in UTC.
    "2018-03-11T02:30": dt.datetime(2018, 3, 11, 2, 30),
}
REFUSED = [
    "", "not a date", "2018-13-01", "18-05-26", "2018-05-26 10:11:12", "2018-02-30",
    "2018-05-26T25", "2018\n", "2018-05-26Z", "-5", "2018-05-26T10:11:12+99:00",
]


def test_dates(spark):
    rows = spark.createDataFrame([(d,) for d in [*DATES, *REFUSED]], "d string")
    parsed = {r.d: r.m for r in rows.select("d", parse_date(F.col("d")).alias("m")).collect()}
    assert parsed == {**DATES, **dict.fromkeys(REFUSED)}


@pytest.mark.parametrize(
    ("query", "low", "high"),
    [
        ("2018", "2018-01-01", "2019-01-01"),
        ("2018-12", "2018-12-01", "2019-01-01"),
        ("2018-05-31", "2018-05-31", "2018-06-01"),
        ("2018-05-26T10", "2018-05-26T10:00", "2018-05-26T11:00"),
        ("2018-05-26T10:11+02:00", "2018-05-26T08:11", "2018-05-26T08:12"),
        ("2018-05-26T10:11:12", "2018-05-26T10:11:12", "2018-05-26T10:11:13"),
        ("2018-05-26T10:11:12.5", "2018-05-26T10:11:12.500", "2018-05-26T10:11:12.501"),
        ("1527292800000", "2018-05-26", "2018-05-26T00:00:00.001"),
    ],
)
def test_date_periods(spark, query, low, high):
    bounds = spark.range(1).select(*date_period(query)).first()
    assert tuple(bounds) == (dt.datetime.fromisoformat(low), dt.datetime.fromisoformat(high))


def test_versions(spark):
    """An underscore, at most one plus sign, digits to the end, at most 32 bits."""
    expected = {
        "news_12": 12, "news_+12": 12, "news_0012": 12, "n_e_w_s_3": 3, "news_0": 0, "_9": 9, "news__9": 9,
        "news_4294967295": 4294967295, "news_4294967296": None, "news_99999999999999999999": None,
        "news": None, "news12": None, "news_": None, "news_+": None, "news_-1": None, "news_++1": None,
        "news_1a": None, "news_1 ": None, "news_1_": None, "news_1\n": None, "": None, "news_\u0663": None,
    }
    rows = spark.createDataFrame([(n,) for n in expected], "n string")
    found = {r.n: r.v for r in rows.select("n", names.version_of(F.col("n")).alias("v")).collect()}
    assert found == expected
    assert {n: names.parse_version(n) for n in expected} == expected
    assert names.table_name("articles", names.next_version(None)) == "articles_1"
    assert names.next_version(41) == 42


def test_stored_length_keeps_four_binary_digits(spark):
    def by_hand(n):
        if n < 40:
            return n
        over, dropped = n - 24, (n - 24).bit_length() - 4
        return 24 + (over >> dropped << dropped)

    rows = spark.range(100_000).select("id", stored_length(F.col("id")).alias("s")).collect()
    assert all(r.s == by_hand(r.id) for r in rows)


def test_significance(spark):
    def score(*counts):
        return spark.range(1).select(significance(*[F.lit(c) for c in counts])).first()[0]

    assert score(10, 10, 10, 100) == pytest.approx((1 - 0.1) * 10)
    assert score(1, 10, 50, 100) == 0
