"""DuckDB statements for the queries that SQL can express, over the same tables."""

from __future__ import annotations

DECONTAMINATE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
    FROM benchmark),
starts AS (
    SELECT item_id, w, least(len(w), 10) AS size,
        unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
    FROM items WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS t
    FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM docs, sizes WHERE len(w) >= size),
grams AS (
    SELECT row_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS t
    FROM places),
hits AS (SELECT row_id, i, g.size, item_id FROM grams g JOIN windows USING (size, t)),
covered AS (
    SELECT row_id, count(DISTINCT p) AS n_hit
    FROM (SELECT row_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY row_id),
found AS (
    SELECT row_id, count(DISTINCT item_id) AS n_items,
        array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids
    FROM hits GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row_id) LEFT JOIN found USING (row_id)
"""

SUBSTRINGS = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h,
        strlen(coalesce(text, '')) AS n
    FROM documents),
places AS (SELECT row_id, h, unnest(range(0, n - 399)) AS i FROM docs WHERE n >= 400),
strings AS (SELECT row_id, i, md5(substr(h, 2 * i + 1, 800)) AS s FROM places),
again AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
hits AS (SELECT row_id, i FROM strings SEMI JOIN again USING (s)),
marked AS (
    SELECT row_id, i, coalesce(i > lag(i) OVER (PARTITION BY row_id ORDER BY i) + 400, TRUE) AS new FROM hits),
numbered AS (
    SELECT row_id, i, sum(new::INT) OVER (PARTITION BY row_id ORDER BY i) AS span FROM marked),
spans AS (SELECT row_id, span, min(i) AS b, max(i) + 400 AS e FROM numbered GROUP BY ALL),
gaps AS (
    SELECT row_id, b, e, coalesce(lag(e) OVER (PARTITION BY row_id ORDER BY b), 0) AS before FROM spans),
parts AS (
    SELECT row_id, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed, max(e) AS last,
        string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS kept
    FROM gaps JOIN docs USING (row_id) GROUP BY row_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM docs LEFT JOIN parts USING (row_id)
"""

SECRETS = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
patterns(kind, p) AS (VALUES
    (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (1, 'AKIA[A-Z0-9]{16,}'), (2, '[0-9a-f]{24,}'), (3, '[A-Za-z0-9+/_=-]{20,}')),
found AS (
    SELECT row_id, kind, p, regexp_extract_all(t, p) AS ms, string_split_regex(t, p) AS ps
    FROM docs, patterns WHERE regexp_matches(t, p)),
each AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM found),
placed AS (
    SELECT row_id, kind, p, ms[k] AS m, (list_sum(list_transform(ps[1:k], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS b
    FROM each),
base AS (
    SELECT row_id, kind, b, b + length(m) AS e FROM placed
    WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(m, p, 2)) >= 6),
encodings(number, fits, alphabet) AS (VALUES
    (0, '^[0-9a-f]+$', '0123456789abcdef'), (1, '^[0-9A-F]+$', '0123456789ABCDEF'),
    (2, '^[a-z]+$', 'abcdefghijklmnopqrstuvwxyz'), (3, '^[A-Z]+$', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'),
    (4, '^[A-Za-z]+$', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'),
    (5, '^[A-Z2-7]+$', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'),
    (6, '^[0-9a-z]+$', '0123456789abcdefghijklmnopqrstuvwxyz'),
    (7, '^[0-9A-Z]+$', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'),
    (8, '^[A-Za-z0-9+/]+$', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'),
    (9, '^[A-Za-z0-9_-]+$', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_')),
runs AS (SELECT row_id, b, m, regexp_replace(m, '=+$', '') AS bare FROM placed WHERE kind = 3),
unfit AS (SELECT * FROM runs WHERE NOT EXISTS (SELECT 1 FROM encodings WHERE regexp_matches(bare, fits))),
part_found AS (
    SELECT row_id, b, regexp_extract_all(m, p) AS ms, string_split_regex(m, p) AS ps
    FROM unfit, (VALUES ('[A-Za-z0-9+/]{20,}'), ('[A-Za-z0-9_-]{20,}'), ('[A-Za-z0-9]{20,}')) AS parts(p)
    WHERE regexp_matches(m, p)),
part_each AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM part_found),
parts AS (
    SELECT DISTINCT row_id, (b + list_sum(list_transform(ps[1:k], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS b, ms[k] AS m
    FROM part_each),
candidates AS (
    SELECT row_id, b, m, bare, 0 AS more FROM runs
    UNION ALL SELECT row_id, b, m, regexp_replace(m, '=+$', ''), 10000 FROM parts),
tokens AS (
    SELECT row_id, b, b + length(m) AS e, bare, more, min(number) AS number, arg_min(alphabet, number) AS alphabet
    FROM candidates JOIN encodings ON regexp_matches(bare, fits)
    WHERE regexp_matches(m, '[A-Za-z]') AND length(bare) >= 20 GROUP BY ALL),
sums AS (
    SELECT row_id, b, e, more + 100 * number AS class, length(bare)::DOUBLE AS n, length(alphabet)::DOUBLE AS k,
        list_transform(string_split(bare, ''), lambda c: instr(alphabet, c) - 1) AS v,
        list_sum(list_transform(string_split(alphabet, ''),
            lambda c: pow(length(bare) - length(replace(bare, c, '')), 2))) AS squares,
        regexp_replace(bare, '[^A-Za-z0-9]', '', 'g') AS plain, (len(regexp_extract_all(plain, '[a-z]+'))
            + len(regexp_extract_all(plain, '[A-Z]+')) + len(regexp_extract_all(plain, '[0-9]+')) - 1)::DOUBLE AS changes,
        (length(plain) - 1)::DOUBLE AS neighbours,
        CASE WHEN regexp_matches(plain, '[a-z]') AND regexp_matches(plain, '[A-Z]') THEN 0.3 ELSE 0.1 END::DOUBLE AS rate
    FROM tokens),
scores AS (
    SELECT row_id, b, e, class, n, (k / n * squares - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z_chi,
        (list_sum(list_transform(range(1, n::BIGINT), lambda i: ((v[i] >= k / 2) <> (v[i + 1] >= k / 2))::INT))
            - (n - 1) / 2) / (sqrt(n - 1) / 2) AS z_runs,
        list_sum(list_transform(range(1, n::BIGINT), lambda i: (v[i] - (k - 1) / 2) * (v[i + 1] - (k - 1) / 2)))
            / ((k * k - 1) / 12 * sqrt(n - 1)) AS z_serial,
        (squares - n) / 2 AS pairs, greatest(0.06::DOUBLE, 2 / k) * n * (n - 1) / 2 AS expected,
        changes, neighbours, rate, neighbours - changes AS kept
    FROM sums),
evidences AS (
    SELECT row_id, b, e, class, n, abs(z_chi) <= 3.29 AND abs(z_runs) <= 3.29 AND abs(z_serial) <= 3.29 AS random,
        CASE WHEN pairs >= expected THEN 0
            ELSE expected - pairs + CASE WHEN pairs > 0 THEN pairs * ln(pairs / expected) ELSE 0 END END
        + CASE WHEN changes <= rate * neighbours THEN 0
            ELSE changes * ln(changes / (neighbours * rate))
                + CASE WHEN kept > 0 THEN kept * ln(kept / (neighbours * (1 - rate))) ELSE 0 END END AS evidence
    FROM scores),
binned AS (
    SELECT row_id, b, e, (floor(2 * log2(n)) + class)::INT AS length_class,
        CASE WHEN random THEN least(floor(4 * (evidence - ln(1 + evidence))), 400)::INT ELSE 0 END AS bin
    FROM evidences),
ranked AS (
    SELECT length_class, bin, sum(count(*)) OVER (PARTITION BY length_class ORDER BY bin DESC) AS rank,
        sum(count(*)) OVER (PARTITION BY length_class) AS all_of
    FROM binned GROUP BY length_class, bin),
cuts AS (
    SELECT length_class, min(bin) AS cut FROM ranked
    WHERE bin > 0 AND exp(-bin / 4) <= rank * 0.01 / all_of GROUP BY length_class),
passed AS (
    SELECT row_id, b, e FROM binned JOIN cuts USING (length_class)
    WHERE bin >= cut AND NOT EXISTS (
        SELECT 1 FROM base WHERE base.row_id = binned.row_id AND base.b < binned.e AND binned.b < base.e)),
added AS (
    SELECT row_id, 3 AS kind, b, e FROM passed x WHERE NOT EXISTS (
        SELECT 1 FROM passed y
        WHERE y.row_id = x.row_id AND y.b <= x.b AND x.e <= y.e AND y.e - y.b > x.e - x.b)),
spans AS (
    SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || b || ':' || e AS s
    FROM (FROM base UNION ALL FROM added)),
listed AS (
    SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
        count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_random,
        string_agg(s, ',' ORDER BY b, kind, e) FILTER (kind < 3) AS base_spans,
        string_agg(s, ',' ORDER BY b, kind, e) AS spans
    FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
    coalesce(n_hex, 0)::BIGINT AS n_hex, coalesce(n_random, 0)::BIGINT AS n_random,
    sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (row_id)
"""

PERSONAL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
patterns(kind, p) AS (VALUES
    (0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
    (2, '[0-9]([\x20-]?[0-9])+'), (3, '\+[0-9][\x20().0-9-]+[0-9]'),
    (4, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b'),
    (5, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b'),
    (6, '\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}\b|\b[0-9]{3}[-.\x20][0-9]{3}[-.\x20][0-9]{4}\b')),
kinds(kind, name, prior, supporting) AS (VALUES
    (0, 'email', 80, 'email|mail|contact|write|kontakt|correo|courriel'),
    (1, 'ip', 60, 'ip|address|server|host|client|adresse'),
    (2, 'card', 80, 'card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta'),
    (3, 'phone', 60, 'phone|tel|telephone|call|mobile|cell|fax|contact|telefon|handy|telefono'),
    (4, 'iban', 70, 'iban|account|bank|swift|bic|konto|compte|cuenta'),
    (5, 'ssn', 40, 'ssn|social|security|taxpayer'),
    (6, 'local', 40, 'phone|tel|telephone|call|mobile|cell|fax|contact|telefon|handy|telefono')),
found AS (
    SELECT row_id, t, kind, regexp_extract_all(t, p) AS ms, string_split_regex(t, p) AS ps
    FROM docs, patterns WHERE regexp_matches(t, p)),
each AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM found),
placed AS (
    SELECT row_id, t, kind, ms[k] AS m, regexp_replace(ms[k], '[^0-9]', '', 'g') AS digits,
        replace(ms[k], ' ', '') AS account, (list_sum(list_transform(ps[1:k], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS b
    FROM each),
valid AS (
    SELECT row_id, t, kind, b, b + length(m) AS e FROM placed
    WHERE CASE kind WHEN 0 THEN TRUE
        WHEN 1 THEN list_bool_and(list_transform(string_split(m, '.'),
            lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))
        WHEN 2 THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1),
            lambda i: CASE WHEN i % 2 = 1 THEN digits[-i]::INT
                ELSE 2 * digits[-i]::INT - CASE WHEN digits[-i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
        WHEN 3 THEN length(digits) BETWEEN 8 AND 15
        WHEN 4 THEN length(account) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(
            string_split(account[5:] || account[:4], ''),
            lambda c: (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)::BIGINT)),
            lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
        WHEN 5 THEN m[:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000'
        ELSE TRUE END),
near AS (
    SELECT *, lower(regexp_replace(CASE WHEN b >= 41 THEN substr(t, b - 40, 41) ELSE ' ' || substr(t, 1, b) END
        || ' ' || CASE WHEN e + 21 <= length(t) THEN substr(t, e + 1, 21) ELSE substr(t, e + 1) || ' ' END,
        '[^\x00-\x7F]', '|', 'g')) AS w
    FROM valid),
scored AS (
    SELECT row_id, kind, name, b, e, prior
        + CASE WHEN regexp_matches(w, '[^a-z0-9_](' || supporting || ')[^a-z0-9_]') THEN 20 ELSE 0 END
        - CASE WHEN regexp_matches(w, '[^a-z0-9_](example|sample|dummy|version|release|section|isbn|order|invoice|tracking|serial)[^a-z0-9_]')
            THEN 30 ELSE 0 END AS score
    FROM near JOIN kinds USING (kind)),
base AS (SELECT * FROM scored WHERE kind < 4),
ibans AS (
    SELECT * FROM scored s WHERE kind = 4 AND score >= 60 AND NOT EXISTS (
        SELECT 1 FROM base o WHERE o.row_id = s.row_id AND o.b < s.e AND s.b < o.e)),
ssns AS (
    SELECT * FROM scored s WHERE kind = 5 AND score >= 60 AND NOT EXISTS (
        SELECT 1 FROM (FROM base UNION ALL FROM ibans) o WHERE o.row_id = s.row_id AND o.b < s.e AND s.b < o.e)),
locals AS (
    SELECT * FROM scored s WHERE kind = 6 AND score >= 60 AND NOT EXISTS (
        SELECT 1 FROM (FROM base UNION ALL FROM ibans UNION ALL FROM ssns) o
        WHERE o.row_id = s.row_id AND o.b < s.e AND s.b < o.e)),
spans AS (
    SELECT *, name || ':' || b || ':' || e AS s
    FROM (FROM base UNION ALL FROM ibans UNION ALL FROM ssns UNION ALL FROM locals)),
listed AS (
    SELECT row_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip,
        count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
        count(*) FILTER (kind = 4) AS n_iban, count(*) FILTER (kind = 5) AS n_ssn,
        count(*) FILTER (kind = 6) AS n_local,
        string_agg(s, ',' ORDER BY kind, b) FILTER (kind < 4) AS base_spans,
        string_agg(s, ',' ORDER BY kind, b) AS spans, string_agg(score::VARCHAR, ',' ORDER BY kind, b) AS scores
    FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip,
    coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
    coalesce(n_iban, 0)::BIGINT AS n_iban, coalesce(n_ssn, 0)::BIGINT AS n_ssn,
    coalesce(n_local, 0)::BIGINT AS n_local, sha256(coalesce(base_spans, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM docs LEFT JOIN listed USING (row_id)
"""

SPELLING = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)),
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents),
bytes AS (
    SELECT doc_id, run, count(*) AS times, hex(encode(doc_id::VARCHAR || ':' || run)) AS h FROM runs GROUP BY ALL),
hashed AS (
    SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) AS h
    FROM bytes, crc_table),
counted AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
        sum(times)::BIGINT AS n
    FROM hashed GROUP BY ALL),
words AS (SELECT word, n FROM counted WHERE length(word) >= 7 AND n >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
skipped AS (
    SELECT word, n, i, left(word, i - 1) AS before, substr(word, i + 1) AS behind FROM places),
links AS (
    SELECT DISTINCT a.word, b.word AS other, b.n AS other_n
    FROM skipped a JOIN skipped b USING (before, behind) WHERE a.word <> b.word
    UNION SELECT s.word, w.word, w.n FROM skipped s JOIN words w ON w.word = s.before || s.behind
    UNION SELECT w.word, s.word, s.n FROM skipped s JOIN words w ON w.word = s.before || s.behind),
best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n
    FROM links GROUP BY word),
forms AS (SELECT word, other AS form, other_n AS form_n FROM best JOIN words USING (word) WHERE other_n >= 10 * n),
ways(word, last) AS (
    SELECT word, word FROM words UNION ALL SELECT ways.word, form FROM ways JOIN forms ON forms.word = ways.last),
roots AS (SELECT word, last AS root FROM ways WHERE last NOT IN (SELECT word FROM forms))
SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) JOIN roots USING (word)
"""

ORACLES: dict[str, str] = {
    "op4_decontaminate": DECONTAMINATE,
    "op8_substrings": SUBSTRINGS,
    "op9_secrets": SECRETS,
    "op11_spelling": SPELLING,
    "op12_personal": PERSONAL,
}
