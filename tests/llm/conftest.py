import pytest

from newsloom.llm import common

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(seed, n):
    """Words that look drawn at random, and are the same every time."""
    out, state = [], seed * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + str((state >> 16) % 50))
    return " ".join(out)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    common.ship(spark)


#: Names the operators use inside; tables may have columns of these names too.
CLASHING = [
    "kept", "score", "n_words", "fp", "row", "_row", "_hash", "_check", "hash", "held_out", "token",
    "spans", "core", "k1", "label", "words", "batch", "_base", "_tokens", "window", "_stay_id", "begin",
]

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashing=False):
        full = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashing:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, rows without id."""
    long_text = sentence(5, 30_000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, sentence(1, 80)), (6, sentence(1, 80)),
        (6, sentence(1, 80)), (7, long_text), (None, sentence(2, 60)), (None, None),
        (8, "x" * 50_000), (9, "Grüße, 中文 und 😀 " * 30), (10, "a\n" * 400), (11, "\x00\x01 tab\x0bend"),
    ]


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_rows):
    return make_docs(odd_rows, clashing=True)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def make_labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    return make
