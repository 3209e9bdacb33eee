"""DuckDB statements that state the expected result of each registered query."""

from __future__ import annotations

# --- fixed values: character sets of the word-break rules, as in the engine ------
_COMPLEX = r"\x{0E01}-\x{0E3A}\x{0E40}-\x{0E4E}\x{0E81}-\x{0ECD}\x{1000}-\x{103F}\x{1050}-\x{108F}\x{1780}-\x{17D3}"
_SINGLE = r"\x{3005}-\x{3007}\x{3041}-\x{3096}\x{309D}-\x{309F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAD9}\x{20000}-\x{323AF}"
_KATAKANA = r"\x{3031}-\x{3035}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}"
_EXTEND = r"\p{M}\x{00AD}\x{200C}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}"
_MID_LETTER = "[''’‘.․:··‧：．＇]"
_MID_NUMBER = "[''’‘.․,;⁄，；．＇]"
_EMOJI = r"\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1FAFF}"
_SKIN = r"\x{1F3FB}-\x{1F3FF}"
# ---------------------------------------------------------------------------------

_LETTER = rf"[^\P{{L}}{_COMPLEX}{_SINGLE}{_KATAKANA}]"
_LETTERS = rf"{_LETTER}(?:{_LETTER}|[{_EXTEND}])*"
_DIGITS = rf"\p{{Nd}}[\p{{Nd}}{_EXTEND}]*"
_JOINERS = rf"\p{{Pc}}[\p{{Pc}}{_EXTEND}]*"
_PART = (
    rf"(?:(?:{_LETTERS}(?:{_MID_LETTER}[{_EXTEND}]*{_LETTERS})*"
    rf"|{_DIGITS}(?:{_MID_NUMBER}[{_EXTEND}]*{_DIGITS})*)+"
    rf"|[{_KATAKANA}][{_KATAKANA}{_EXTEND}]*)"
)
_WORD = "|".join(
    [
        rf"(?:{_JOINERS})?{_PART}(?:{_JOINERS}{_PART})*(?:{_JOINERS})?",
        rf"[{_SINGLE}][{_EXTEND}]*",
        rf"[{_COMPLEX}]+",
        rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[{_EMOJI}](?:\x{{200D}}[{_EMOJI}]|[{_EXTEND}{_SKIN}])*",
    ]
)


def _tokens(column: str) -> str:
    words = f"regexp_extract_all(lower({column}), '{_WORD}')"
    return f"flatten(list_transform({words}, lambda word: regexp_extract_all(word, '(?s).{{1,255}}')))"


_ARTICLES = """articles AS (
  SELECT doc_id, source AS category, split_part(text, chr(10), 1) AS headline, lang AS authors,
         'doc://' || doc_id AS link, text AS short_description,
         strftime(DATE '2018-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS date
  FROM documents)"""
_RAW = "category, headline, authors, link, short_description, date"
_KEPT = "(doc_id % 30 < 5 OR doc_id % 30 > 20)"

_TOTALS = f"""lexicon(word, valence) AS (
  VALUES ('the', 2), ('of', 1), ('erst', 3), ('in', -2), ('and', -1)),
tokens AS (SELECT doc_id, unnest({_tokens("short_description")}) AS word FROM articles),
totals AS (
  SELECT doc_id, sum(greatest(valence, 0)) AS positive, sum(greatest(-valence, 0)) AS negative
  FROM tokens JOIN lexicon USING (word) GROUP BY doc_id),
enriched AS (
  SELECT a.*, CAST(greatest(coalesce(positive, 0), coalesce(negative, 0)) AS DOUBLE) AS sentiment_score,
         CASE WHEN coalesce(negative, 0) > coalesce(positive, 0) THEN 'Negative' ELSE 'Positive' END
           AS sentiment_polarity,
         CAST(coalesce(positive, 0) AS BIGINT) AS positive, CAST(coalesce(negative, 0) AS BIGINT) AS negative
  FROM articles a LEFT JOIN totals USING (doc_id))"""
_SENTIMENT = f"{_ARTICLES}, {_TOTALS}"


def _words(*words: str) -> str:
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


def _matches(field: str, *words: str) -> str:
    return f"list_has_any({_tokens(field)}, {_words(*words)})"


def _top(source: str, column: str, condition: str = "TRUE", size: int = 10) -> str:
    return f"""SELECT {column} AS key, count(*) AS doc_count FROM {source} WHERE {condition}
GROUP BY 1 ORDER BY doc_count DESC, key LIMIT {size}"""


def _bm25(query: list[str], boosts: dict[str, float]) -> str:
    """Ranked rows as ``ranked(doc_id, score)``."""
    words = ", ".join(f"('{word}', {query.count(word)})" for word in sorted(set(query)))
    parts = " UNION ALL ".join(
        f"SELECT doc_id, '{field}' AS field, CAST({boost} AS DOUBLE) AS boost, {_tokens(field)} AS tokens FROM articles"
        for field, boost in boosts.items()
    )
    return f"""{_ARTICLES}, words(term, repeats) AS (VALUES {words}),
parts AS ({parts}),
corpus AS (SELECT field, count(*) AS n, sum(len(tokens)) / count(*) AS mean_length
           FROM parts WHERE len(tokens) > 0 GROUP BY field),
entries AS (SELECT doc_id, field, boost, len(tokens) AS dl, unnest(tokens) AS term FROM parts),
counts AS (SELECT doc_id, field, boost, dl, term, count(*) AS tf
           FROM entries SEMI JOIN words USING (term) GROUP BY ALL),
rarity AS (SELECT c.field, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
           FROM counts c JOIN corpus USING (field) GROUP BY c.field, term),
stored AS (SELECT *, CASE WHEN dl < 40 THEN dl ELSE 24 + (((dl - 24) >> CAST(length(bin(dl - 24)) - 4 AS BIGINT))
             << CAST(length(bin(dl - 24)) - 4 AS BIGINT)) END AS length FROM counts),
fields AS (SELECT doc_id, s.field, any_value(boost) * sum(
             2.2 * repeats * idf * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
           FROM stored s JOIN words USING (term) JOIN rarity r ON r.field = s.field AND r.term = s.term
           JOIN corpus p ON p.field = s.field GROUP BY doc_id, s.field),
best AS (SELECT doc_id, max(score) AS exact FROM fields GROUP BY doc_id),
ranked AS (SELECT doc_id, round(exact, 6) AS score FROM best
           ORDER BY CAST(exact AS FLOAT) DESC, doc_id LIMIT 10)"""


def _hits(query: list[str], boosts: dict[str, float], columns: str = "doc_id, category, link, score") -> str:
    return f"WITH {_bm25(query, boosts)} SELECT {columns} FROM ranked JOIN articles USING (doc_id)"


def _constant_hits(condition: str, score: str) -> str:
    return f"""WITH {_ARTICLES} SELECT doc_id, category, link, {score} AS score
FROM articles WHERE {condition} ORDER BY doc_id LIMIT 10"""


def _significant(field: str, words: list[str], size: int) -> str:
    return f"""WITH {_ARTICLES}, rows_of AS (
  SELECT list_distinct({_tokens(field)}) AS words, {_matches(field, *words)} AS hit FROM articles),
sizes AS (SELECT count(*) FILTER (hit) AS fg, count(*) AS bg FROM rows_of),
per_word AS (SELECT hit, unnest(words) AS key FROM rows_of),
counts AS (SELECT key, count(*) FILTER (hit) AS doc_count, count(*) AS bg_count FROM per_word GROUP BY key),
shares AS (SELECT *, doc_count / (SELECT fg FROM sizes) AS fp, bg_count / (SELECT bg FROM sizes) AS bp
           FROM counts WHERE doc_count >= 3)
SELECT key, doc_count, round((fp - bp) * (fp / bp), 9) AS score, bg_count
FROM shares WHERE fp > bp ORDER BY (fp - bp) * (fp / bp) DESC, key LIMIT {size}"""


_FIELD_TOKENS = f"""{_ARTICLES}, parts AS (
  SELECT doc_id, 'headline' AS field, {_tokens("headline")} AS tokens FROM articles
  UNION ALL SELECT doc_id, 'authors', {_tokens("authors")} FROM articles
  UNION ALL SELECT doc_id, 'short_description', {_tokens("short_description")} FROM articles)"""

_DAY = "strftime(day, '%Y-%m-%d')"
_DATES = f"""days AS (SELECT doc_id, DATE '2018-01-01' + CAST(doc_id % 365 AS INTEGER) AS day FROM documents),
dates AS (SELECT doc_id, CASE doc_id % 16
    WHEN 0 THEN {_DAY} WHEN 1 THEN strftime(day, '%Y-%m') WHEN 2 THEN strftime(day, '%Y')
    WHEN 3 THEN {_DAY} || 'T10' WHEN 4 THEN {_DAY} || 'T10:11' WHEN 5 THEN {_DAY} || 'T10:11:12.345Z'
    WHEN 6 THEN {_DAY} || 'T10:11:12+02:00' WHEN 7 THEN {_DAY} || 'T10:11:12-0230'
    WHEN 8 THEN {_DAY} || 'T10:11:12,5Z' WHEN 9 THEN CAST(epoch_ms(day) AS VARCHAR)
    WHEN 10 THEN '' WHEN 11 THEN 'not a date' WHEN 12 THEN strftime(day, '%Y') || '-13-01'
    WHEN 13 THEN strftime(day, '%y-%m-%d') WHEN 14 THEN {_DAY} || ' 10:11:12' ELSE {_DAY} || 'T25' END AS date,
  CASE doc_id % 16 WHEN 0 THEN CAST(day AS TIMESTAMP) WHEN 1 THEN date_trunc('month', CAST(day AS TIMESTAMP))
    WHEN 2 THEN date_trunc('year', CAST(day AS TIMESTAMP)) WHEN 3 THEN day + INTERVAL 10 HOUR
    WHEN 4 THEN day + INTERVAL 611 MINUTE WHEN 5 THEN day + INTERVAL 36672345 MILLISECOND
    WHEN 6 THEN day + INTERVAL 29472 SECOND WHEN 7 THEN day + INTERVAL 45672 SECOND
    WHEN 8 THEN day + INTERVAL 36672500 MILLISECOND WHEN 9 THEN CAST(day AS TIMESTAMP) END AS moment
  FROM days)"""

_SUMMARY = """SELECT count(*) AS total_indexed, count(*) FILTER (doc_id % 16 < 10) AS accepted,
  count(*) FILTER (doc_id % 16 >= 10) AS rejected, 'articles_2' AS new_index_name,
  count(*) FILTER (doc_id % 5 = 0) AS dropped, FALSE AS limit_cut FROM documents"""

# A word in every text weighs little; texts differ in their lengths only.
_EVERYWHERE = f"""{_ARTICLES}, parts AS (
  SELECT doc_id, link, list_prepend('reuters', {_tokens("short_description")}) AS tokens FROM articles),
sized AS (SELECT doc_id, link, len(tokens) AS dl, len(list_filter(tokens, lambda t: t = 'reuters')) AS tf FROM parts),
corpus AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean_length FROM sized),
stored AS (SELECT *, CASE WHEN dl < 40 THEN dl ELSE 24 + (((dl - 24) >> CAST(length(bin(dl - 24)) - 4 AS BIGINT))
           << CAST(length(bin(dl - 24)) - 4 AS BIGINT)) END AS length FROM sized),
scored AS (SELECT doc_id, link, 2.2 * ln(1 + 0.5 / (n + 0.5)) * tf
           / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) AS exact FROM stored, corpus),
ranked AS (SELECT doc_id, link, round(exact, 12) AS score FROM scored
           ORDER BY CAST(exact AS FLOAT) DESC, doc_id LIMIT 10)"""

ORACLES: dict[str, str] = {
    "ndjson_scan_strict": f"WITH {_ARTICLES} SELECT {_RAW} FROM articles WHERE {_KEPT}",
    "first_n_rows": f"""WITH {_ARTICLES} SELECT link, headline, date FROM articles WHERE {_KEPT}
ORDER BY doc_id LIMIT 250""",
    "first_n_rows_one_file": f"""WITH {_ARTICLES} SELECT link, headline, date FROM articles WHERE {_KEPT}
ORDER BY doc_id LIMIT 250""",
    "date_conformance": f"WITH {_DATES} SELECT doc_id, date, moment IS NOT NULL AS accepted, "
    "coalesce(CAST(moment AS VARCHAR), 'refused') AS moment FROM dates",
    "rejected_articles": """SELECT 'doc://' || doc_id AS link,
  CASE WHEN doc_id % 16 < 10 THEN 'accepted' ELSE 'rejected' END AS outcome FROM documents""",
    "tokenize": f"""WITH t AS (SELECT doc_id, {_tokens("text")} AS tokens FROM documents)
SELECT doc_id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct,
  md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM t""",
    "sentiment_enrich": f"WITH {_SENTIMENT} SELECT doc_id, {_RAW}, sentiment_score, sentiment_polarity FROM enriched",
    "sentiment_totals_large_lexicon": f"WITH {_SENTIMENT} SELECT doc_id, positive, negative FROM enriched",
    "sentiment_large_lexicon": f"""WITH {_ARTICLES},
tokens AS (SELECT doc_id, unnest({_tokens("short_description")}) AS word FROM articles),
valued AS (SELECT doc_id, length(word) % 5 - 2 AS valence FROM tokens),
totals AS (SELECT doc_id, sum(greatest(valence, 0)) AS positive, sum(greatest(-valence, 0)) AS negative
           FROM valued GROUP BY doc_id)
SELECT doc_id, CAST(CAST(greatest(coalesce(positive, 0), coalesce(negative, 0)) AS FLOAT) AS DOUBLE) AS sentiment_score,
  CASE WHEN coalesce(negative, 0) > coalesce(positive, 0) THEN 'Negative' ELSE 'Positive' END AS sentiment_polarity
FROM articles LEFT JOIN totals USING (doc_id)""",
    "match_any_token": f"WITH {_ARTICLES} SELECT doc_id FROM articles WHERE {_matches('short_description', 'erst', 'ther')}",
    "match_keyword": f"WITH {_ARTICLES} SELECT doc_id FROM articles WHERE category = 'src3'",
    "match_link": f"WITH {_ARTICLES} SELECT doc_id FROM articles WHERE link = 'doc://17'",
    "match_date": f"WITH {_ARTICLES} SELECT doc_id FROM articles WHERE date LIKE '2018-05-%'",
    "match_date_hour": f"WITH {_ARTICLES} SELECT doc_id FROM articles WHERE date = '2018-05-26' AND doc_id % 7 = 5",
    "match_date_minute": f"""WITH {_ARTICLES} SELECT doc_id FROM articles
WHERE date = '2018-02-03' AND doc_id % 7 = 5 AND doc_id % 50 = 33""",
    "match_all": f"WITH {_ARTICLES} SELECT doc_id FROM articles",
    "match_polarity": f"WITH {_SENTIMENT} SELECT doc_id FROM enriched WHERE sentiment_polarity = 'Negative'",
    "sentiment_stats": f"WITH {_SENTIMENT} " + _top("enriched", "sentiment_polarity", _matches("short_description", "erst")),
    "sentiment_stats_all": f"WITH {_SENTIMENT} " + _top("enriched", "sentiment_polarity"),
    "category_stats": f"WITH {_ARTICLES} " + _top("articles", "category", _matches("short_description", "ther")),
    "category_stats_all": f"WITH {_ARTICLES} " + _top("articles", "category"),
    "category_stats_headline": f"WITH {_ARTICLES} " + _top("articles", "category", _matches("headline", "the")),
    "category_stats_date": f"WITH {_ARTICLES} " + _top("articles", "category", "date LIKE '2018-03-%'"),
    "terms_with_other": f"""WITH {_ARTICLES}, top AS ({_top("articles", "category")})
SELECT CAST((SELECT count(*) FROM articles) - (SELECT sum(doc_count) FROM top) AS BIGINT) AS sum_other_doc_count,
  CAST(0 AS BIGINT) AS doc_count_error_upper_bound""",
    "terms_return_flags": _top("lineitem", "l_returnflag"),
    "terms_order_priorities_top_3": _top("orders", "o_orderpriority", size=3),
    "terms_of_labels": _top("labels", "quality || '/' || toxic"),
    "order_priorities_in_month": _top(
        "orders", "o_orderpriority", "o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1995-04-01'"
    ),
    "event_types_of_day": _top("events", "event_type", "CAST(ts AS DATE) = DATE '2024-01-02'"),
    "roles_mentioning": _top("conversations", "role", _matches("text", "the")),
    "match_text_bm25": _hits(["erst", "ther"], {"short_description": 1}),
    "match_text_repeated_words": _hits(["erst", "the", "erst"], {"short_description": 1}),
    "search_headline": _hits(["the", "in"], {"headline": 1}),
    "search_multi_field": _hits(["the", "erst", "en"], {"headline": 2, "authors": 1, "short_description": 1}),
    "search_keyword_field": _constant_hits(
        "category = 'src7'",
        """(SELECT round(ln(1 + (count(*) - count(*) FILTER (category = 'src7') + 0.5)
  / (count(*) FILTER (category = 'src7') + 0.5)), 6) FROM articles)""",
    ),
    "search_date_field": _constant_hits("date = '2018-02-03'", "CAST(1 AS DOUBLE)"),
    "search_word_everywhere": f"WITH {_EVERYWHERE} SELECT doc_id, score FROM ranked",
    "search_keyword_everywhere": """SELECT doc_id, round(ln(1 + 0.5 / ((SELECT count(*) FROM documents) + 0.5)), 12) AS score
FROM documents ORDER BY doc_id LIMIT 10""",
    "hit_documents": f"""WITH {_bm25(["the", "erst", "en"], {"headline": 2, "authors": 1, "short_description": 1})},
{_TOTALS}
SELECT doc_id, {_RAW}, sentiment_score, sentiment_polarity FROM ranked JOIN enriched USING (doc_id)""",
    "significant_words": _significant("short_description", ["erst"], 15),
    "significant_words_several": _significant("short_description", ["erst", "ther"], 40),
    "significant_words_headline": _significant("headline", ["the"], 25),
    "foreground_background": f"""WITH {_ARTICLES} SELECT
  count(*) FILTER ({_matches("short_description", "erst")}) AS doc_count, count(*) AS bg_count FROM articles""",
    "term_statistics": f"""WITH {_FIELD_TOKENS}
SELECT field, term, count(*) AS df FROM (SELECT field, unnest(list_distinct(tokens)) AS term FROM parts)
GROUP BY field, term""",
    "corpus_statistics": f"""WITH {_FIELD_TOKENS}
SELECT field, count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens
FROM parts WHERE len(tokens) > 0 GROUP BY field""",
    "row_lengths": f"""WITH {_FIELD_TOKENS}
SELECT field, doc_id, len(tokens) AS length FROM parts WHERE len(tokens) > 0""",
    "search_published": _hits(
        ["the", "erst", "en"], {"headline": 2, "authors": 1, "short_description": 1}, "link, score"
    ),
    "search_published_field": _hits(["erst", "ther"], {"short_description": 1}, "link, score"),
    "search_everywhere_published": f"WITH {_EVERYWHERE} SELECT link, score FROM ranked",
    "significant_sizes": f"""WITH {_ARTICLES} SELECT
  count(*) FILTER ({_matches("short_description", "erst")}) AS doc_count, count(*) AS bg_count FROM articles""",
    "category_stats_sized": f"""WITH {_ARTICLES}, found AS (
  SELECT category FROM articles WHERE {_matches("short_description", "ther")}),
top AS ({_top("found", "category", size=3)})
SELECT key, doc_count FROM top UNION ALL
SELECT '(others)', (SELECT count(*) FROM found) - CAST((SELECT coalesce(sum(doc_count), 0) FROM top) AS BIGINT)""",
    "significant_words_published": _significant("short_description", ["erst"], 15),
    "category_stats_published": f"WITH {_ARTICLES} " + _top("articles", "category", _matches("short_description", "ther")),
    "sentiment_stats_published": f"WITH {_SENTIMENT} "
    + _top("enriched", "sentiment_polarity", _matches("short_description", "erst", "ther")),
    "full_refresh_publish": f"""WITH {_SENTIMENT}
SELECT {_RAW}, CAST(CAST(date AS TIMESTAMP) AS VARCHAR) AS moment, sentiment_score, sentiment_polarity FROM enriched""",
    "published_table_scan": f"WITH {_ARTICLES} SELECT category, link FROM articles WHERE {_KEPT}",
    "published_duplicates": """SELECT 'doc://' || doc_id AS link, CAST(2 AS BIGINT) AS copies,
  CAST(2 AS BIGINT) AS ids FROM documents""",
    "run_summary": _SUMMARY,
    "refresh_after_rollback": f"""SELECT 'articles_1' AS name, FALSE AS published, count(*) AS n FROM documents
UNION ALL SELECT 'articles_2', FALSE, count(*) FROM documents WHERE {_KEPT}
UNION ALL SELECT 'articles_3', TRUE, count(*) FROM documents WHERE {_KEPT}""",
    "refresh_concurrent": f"""SELECT 'articles_3' AS name, 'has not published' AS other, count(*) AS n
FROM documents WHERE {_KEPT}""",
    "match_link_published": f"WITH {_ARTICLES} SELECT link, category FROM articles WHERE link = 'doc://17'",
    "merged_table_scan": f"WITH {_SENTIMENT} SELECT {_RAW}, sentiment_polarity FROM enriched",
    "merged_search": f"""WITH {_bm25(["the", "erst", "en"], {"headline": 2, "authors": 1, "short_description": 1})}
SELECT round(score, 5) AS score FROM ranked""",
    "merged_significant_words": _significant("short_description", ["erst"], 15),
    "snapshot_of_appended": f"WITH {_SENTIMENT} SELECT {_RAW}, sentiment_polarity FROM enriched",
    "stream_scan_during_batch": """SELECT 'during' AS moment, 'doc://' || doc_id AS link FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 'after', 'doc://' || doc_id FROM documents""",
    "version_numbers": """SELECT source || CASE doc_id % 3 WHEN 0 THEN '_' WHEN 1 THEN '_+' ELSE '_v' END || doc_id AS name,
  CASE WHEN doc_id % 3 < 2 THEN doc_id ELSE -1 END AS version FROM documents""",
    "snapshot_roundtrip": f"WITH {_SENTIMENT} SELECT {_RAW}, sentiment_polarity FROM enriched",
    "snapshot_restore_subset": f"WITH {_SENTIMENT} SELECT link, sentiment_polarity FROM enriched WHERE {_KEPT}",
    "stream_follow_files": f"WITH {_SENTIMENT} SELECT {_RAW}, sentiment_polarity FROM enriched WHERE {_KEPT}",
    "stream_two_sources": f"""SELECT 'doc://' || doc_id AS link, CASE WHEN {_KEPT} THEN 2 ELSE 1 END::BIGINT AS copies,
  CASE WHEN {_KEPT} THEN 2 ELSE 1 END::BIGINT AS ids FROM documents""",
    "stream_search_appended": f"""WITH {_bm25(["the", "erst", "en"], {"headline": 2, "authors": 1, "short_description": 1})}
SELECT round(score, 5) AS score FROM ranked""",
    "stream_periodic_refresh": f"WITH {_SENTIMENT} SELECT {_RAW}, sentiment_polarity FROM enriched",
}
