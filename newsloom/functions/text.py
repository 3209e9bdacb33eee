"""Word segmentation of text columns (SF1).

Text fields are analysed the way a search store's standard analyser does:
Unicode word boundaries (UAX #29), lower case, no stop words, no stemming,
tokens longer than 255 characters cut into pieces.  One regular expression,
applied by ``regexp_extract_all``, keeps the whole step inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --- fixed values: character sets of the UAX #29 word-break rules --------------
# Scripts whose letters do not join into alphabetic words: Thai, Lao, Myanmar,
# Khmer (runs), Han and Hiragana (one token per character), Katakana (runs).
_COMPLEX = r"\x{0E01}-\x{0E3A}\x{0E40}-\x{0E4E}\x{0E81}-\x{0ECD}\x{1000}-\x{103F}\x{1050}-\x{108F}\x{1780}-\x{17D3}"
_SINGLE = r"\x{3005}-\x{3007}\x{3041}-\x{3096}\x{309D}-\x{309F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAD9}\x{20000}-\x{323AF}"
_KATAKANA = r"\x{3031}-\x{3035}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}"
# Combining marks and format characters extend whatever they follow.
_EXTEND = r"\p{M}\x{00AD}\x{200C}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}"
# Punctuation that joins letter-letter and digit-digit, respectively.
_MID_LETTER = "['’‘.․:··‧：．＇]"
_MID_NUMBER = "['’‘.․,;⁄，；．＇]"
_EMOJI = r"\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1FAFF}"
_SKIN = r"\x{1F3FB}-\x{1F3FF}"
# Lower-case letters of one byte in Latin-1.
_PLAIN = r"a-z\x{00DF}-\x{00F6}\x{00F8}-\x{00FF}"
_FLAG = r"[\x{1F1E6}-\x{1F1FF}]{2}"
MAX_TOKEN_CHARS = 255
# -------------------------------------------------------------------------------


def _word_pattern() -> str:
    """Possessive throughout, so hostile input can neither backtrack nor recurse."""
    not_alphabetic = rf"[^\P{{L}}{_COMPLEX}{_SINGLE}{_KATAKANA}]"
    letter = rf"[a-z{not_alphabetic}]"
    letters = rf"{letter}[a-z{_EXTEND}{not_alphabetic}]*+"
    digits = rf"\p{{Nd}}[\p{{Nd}}{_EXTEND}]*+"
    joiners = rf"\p{{Pc}}[\p{{Pc}}{_EXTEND}]*+"
    extend = rf"[{_EXTEND}]*+"
    word = rf"{letters}(?:{_MID_LETTER}{extend}{letters})*+"
    number = rf"{digits}(?:{_MID_NUMBER}{extend}{digits})*+"
    katakana = rf"[{_KATAKANA}][{_KATAKANA}{_EXTEND}]*+"
    # Katakana joins with underscores, not directly with other letters.
    part = rf"(?:(?:{word}|{number})++|{katakana})"
    return "|".join(
        [
            # Shortcut, same tokens: a plain word that certainly ends here.
            rf"""[{_PLAIN}]++(?=[,.;:!?"')]*+(?:\s|\z))""",
            rf"(?<!\p{{Pc}})(?:{joiners})?+{part}(?:{joiners}{part})*+(?:{joiners})?+",
            rf"[{_SINGLE}]{extend}",
            rf"[{_COMPLEX}]++",
            rf"{_FLAG}|[{_EMOJI}](?:[{_EXTEND}{_SKIN}]|(?<=\x{{200D}})[{_EMOJI}])*+",
        ]
    )


# Swallowing what follows a word spares the search the places where none begins;
# no word begins with one of these characters.
WORD = rf"""({_word_pattern()})[ \t\r\n,.;:!?"'()-]*+"""
# From the start, over the runs within the limit, to one that is not: one pass.
_LONG_RUN = rf"\A(?:\S{{0,{MAX_TOKEN_CHARS}}}+\s++)*+\S{{{MAX_TOKEN_CHARS + 1}}}"
_PIECE = rf"[^ ]{{1,{MAX_TOKEN_CHARS}}}"


def _extract(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokenise(text: Column) -> Column:
    """Tokens of ``text`` in order, with repetition (``array<string>``).

    Built-in functions with generated code only, so that the scan, this step and
    a filter or projection on it are compiled into one stage.
    """
    return tokenise_lowered(F.lower(text))


def tokenise_lowered(lowered: Column) -> Column:
    """``tokenise`` for text that is in lower case already."""
    tokens = _extract(lowered, WORD, 1)
    cut = _extract(F.array_join(tokens, " "), _PIECE, 0)
    # A token over the limit needs that many characters in a row without a space.
    may_be_long = (F.length(lowered) > MAX_TOKEN_CHARS) & lowered.rlike(_LONG_RUN)
    return F.when(may_be_long, cut).otherwise(tokens)


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    """Tokens of a query string; bounded by the query, evaluated by a job over one row."""
    return list(spark.range(1).select(tokenise(F.lit(query)).alias("tokens")).first().tokens)


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def mentions(lowered: Column, tokens: list[str]) -> Column:
    """Substring test every lower-cased text holding one of ``tokens`` must pass.

    Tokens are substrings of that text, so this test is cheap and spares the
    segmentation of rows that cannot match; one pattern tests for all of them.
    """
    wanted = sorted(set(tokens))
    if len(wanted) == 1:
        return lowered.contains(wanted[0])
    return lowered.rlike("|".join(rf"\Q{token}\E" for token in wanted)) if wanted else F.lit(False)


def has_any_token(text: Column, tokens: list[str]) -> Column:
    """True where ``text`` contains at least one of ``tokens`` as a whole token."""
    if not tokens:
        return F.lit(False)
    lowered = F.lower(text)
    wanted = string_array(sorted(set(tokens)))
    return mentions(lowered, tokens) & F.arrays_overlap(tokenise_lowered(lowered), wanted)
