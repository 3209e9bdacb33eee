"""Lexicon sentiment of a text column (UD1, SF2, PF1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import tokenise
from newsloom.operators.postings import term_counts
from newsloom.schema import NEGATIVE, POSITIVE, RAW_FIELDS
from newsloom.sources.storage import settled

# A lexicon up to the first two sizes becomes hash sets of the expression, up to the last
# one a table of the expression, with so many words to a slot; beyond it, the tokens are
# joined with the lexicon.
MAX_LITERAL_WORDS, MAX_LITERAL_VALENCES, MAX_TABLE_WORDS, WORDS_PER_SLOT = 20_000, 64, 500_000, 2


def require_lexicon(lexicon: DataFrame) -> int:
    """Number of words; an error unless each word is there once, with a valence."""
    known = F.col("word").isNotNull() & F.col("valence").isNotNull()
    row = lexicon.agg(
        F.count("*").alias("n"), F.count_if(known).alias("known"), F.count_distinct("word").alias("words")
    ).first()
    if row.known != row.n:
        raise ValueError("the lexicon has rows without word or valence")
    if row.words != row.n:
        raise ValueError("the lexicon has words more than once")
    return row.n


def sentiment_totals(df: DataFrame, lexicon: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """``df`` with ``positive`` and ``negative``: sums of valences per row.

    Repeated words count each time.  Rows without any lexicon word get (0, 0).  The
    result does not depend on how large the lexicon is.
    """
    n_words = require_lexicon(lexicon)
    weighted = lexicon.where(F.col("valence") != 0)
    if n_words > MAX_TABLE_WORDS:
        return totals_by_join(df, weighted, text, key, small=False)
    if n_words <= MAX_LITERAL_WORDS:
        by_valence: dict[int, list[str]] = {}
        for row in weighted.collect():
            by_valence.setdefault(row.valence, []).append(row.word)
        if len(by_valence) <= MAX_LITERAL_VALENCES:
            return _totals_in_row(df, by_valence, text)
    return totals_by_table(df, weighted, n_words, text)


def _totals_in_row(df: DataFrame, by_valence: dict[int, list[str]], text: str) -> DataFrame:
    """No shuffle: hash-set membership of each token, summed inside the row."""
    known = sorted(word for words in by_valence.values() for word in words)

    def value(token: Column, valences: list[int]) -> Column:
        rest = F.lit(0).cast("bigint")
        return reduce(
            lambda otherwise, v: F.when(token.isin(by_valence[v]), F.lit(abs(v))).otherwise(otherwise),
            valences,
            rest,
        )

    def total(valences: list[int]) -> Column:
        zero = F.lit(0).cast("bigint")
        if not valences:
            return zero
        return F.aggregate("hits", zero, lambda total, token: total + value(token, valences))

    hits = F.filter(tokenise(F.col(text)), lambda token: token.isin(known)) if known else F.array()
    return df.withColumn("hits", hits).select(
        *df.columns,
        total(sorted(v for v in by_valence if v > 0)).alias("positive"),
        total(sorted(v for v in by_valence if v < 0)).alias("negative"),
    )


def totals_by_table(df: DataFrame, lexicon: DataFrame, n_words: int, text: str) -> DataFrame:
    """No shuffle of ``df``: each token is looked up in a hash table that is one constant.

    The table is an array of slots with a few words each.  It is made by Spark and goes
    through the driver as one value of at most ``MAX_TABLE_WORDS`` words; the tasks get it
    with the expression.  Nothing but the lexicon is moved.
    """
    n_slots = max(n_words // WORDS_PER_SLOT, 1)

    def slot_of(word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(n_slots)).cast("int")

    weighted = lexicon.select("word", F.col("valence").cast("bigint").alias("valence"))
    filled = weighted.groupBy(slot_of(F.col("word")).alias("slot")).agg(
        F.collect_list(F.struct("word", "valence")).alias("words")
    )
    slots = lexicon.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("slot"))
    in_order = F.array_sort(F.collect_list(F.struct("slot", "words")))
    written = slots.join(filled, "slot", "left").agg(F.to_json(in_order["words"])).first()[0]
    # One text, which becomes a constant array when the plan is optimized.
    table = F.from_json(F.lit(written), "array<array<struct<word:string,valence:bigint>>>")

    def value(token: Column) -> Column:
        slot = F.coalesce(F.get(table, slot_of(token)), F.array().cast("array<struct<word:string,valence:bigint>>"))
        zero = F.lit(0).cast("bigint")
        return F.aggregate(
            slot, zero, lambda total, entry: F.when(entry["word"] == token, entry["valence"]).otherwise(total)
        )

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("bigint"), lambda total, v: total + v)

    # The table must not become a column, which would hold a copy a row.
    valued = df.withColumn("values", F.transform(tokenise(F.col(text)), value))
    return valued.select(
        *df.columns,
        total(F.filter("values", lambda v: v > 0)).alias("positive"),
        (-total(F.filter("values", lambda v: v < 0))).alias("negative"),
    )


def totals_by_join(
    df: DataFrame, lexicon: DataFrame, text: str, key: str = "doc_id", small: bool = True
) -> DataFrame:
    """For a lexicon too large for one value; ``key`` must identify a row.

    The rows are settled in the scratch folder first: they are made once, and a running
    id is the same in both uses.  Tokens are counted inside each row; what meets the
    lexicon holds no text; a ``small`` lexicon is broadcast, else adaptive execution splits
    the partition of a frequent word.  The totals then meet the rows, which are shuffled.
    """
    rows = settled(df, "articles")
    counts = term_counts(rows, [key], text).select(key, F.col("term").alias("word"), "tf")
    words = lexicon.select("word", "valence")
    valued = counts.join(F.broadcast(words) if small else words, "word")
    gain = F.col("tf") * F.col("valence").cast("bigint")
    totals = valued.groupBy(key).agg(
        F.sum(F.greatest(gain, F.lit(0))).alias("positive"),
        F.sum(F.greatest(-gain, F.lit(0))).alias("negative"),
    )
    return rows.join(totals, key, "left").select(
        *[rows[name] for name in df.columns],
        F.coalesce("positive", F.lit(0)).alias("positive"),
        F.coalesce("negative", F.lit(0)).alias("negative"),
    )


def enrich(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Articles with the score and polarity of their short description.

    The larger total wins; a tie, also of two zeros, is positive.
    """
    scored = sentiment_totals(articles, lexicon, "short_description")
    is_negative = F.col("negative") > F.col("positive")
    others = [name for name in articles.columns if name not in RAW_FIELDS]
    return scored.select(
        *others,
        *RAW_FIELDS,
        F.greatest("positive", "negative").cast("float").alias("sentiment_score"),
        F.when(is_negative, NEGATIVE).otherwise(POSITIVE).alias("sentiment_polarity"),
    )
