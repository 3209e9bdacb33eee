"""Secret scans: patterns, and tokens that pass a battery of randomness tests.

Three patterns give the base spans.  Besides, every run of 20 or more characters of the
usual encodings that has a letter is a candidate; of a run that no encoding fits as a whole
(``NAME=token``, a path before a token), the longest parts that one fits are.  Its encoding
is inferred (hex in either case, letters, base32, base36, base64 with either pair of symbols),
its characters become values of that alphabet, and tests ask whether they look random:

* chi-squared: the characters are spread evenly over the alphabet;
* runs: values above and below the middle change as often as by chance, and so do the kinds
  of characters (upper and lower case, digits);
* serial correlation: a value says nothing of the next one.

The first, the runs of values and the last have exact moments under randomness, and a
candidate that fails one (beyond ``Z_LIMIT`` standard deviations) is no secret.  Two tests
speak against ordinary text.  The chi-squared statistic counts pairs of equal characters, of
which ordinary text has at least ``TEXT_MATCH``; and in ordinary text, symbols aside, at most
``TEXT_CHANGE`` of the neighbours are of different kinds, where an encoding has both cases
``CASED_CHANGE``.  Chernoff bounds (of the Poisson
and of the binomial distribution) give the p-value of each, and Fisher's method combines
them.  Over all documents, and for each length class of each encoding by itself, the
Benjamini-Hochberg rule keeps the false discoveries among the found tokens at
``DISCOVERY_RATE``: short tokens have weak tests and must pass a stricter cut than they would
among long ones.  Parts of runs have cuts of their own; one inside another is not reported.

Only DataFrame functions are used.  Positions of matches come from splitting a text at the
pattern: pieces and matches alternate.

Defined results: NULL and empty texts have no spans; repeated rows get equal spans and
count as often as they occur; rows without id are scanned like others; decimal numbers are
no candidates (from 24 digits on they are base spans); an empty table has no cuts; other columns are ignored, and kept by ``redact``.  Texts are taken whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Runs are maximal, so a lower bound of their length drops just the short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_CANDIDATE = 20
Z_LIMIT = 3.29
TEXT_MATCH, TEXT_CHANGE, CASED_CHANGE = 0.06, 0.1, 0.3
DISCOVERY_RATE = 0.01

_DIGITS, _UP, _LOW = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the narrowest: what a token must match, and its alphabet in order.
ENCODINGS = (
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[a-z]+$", _LOW),
    (r"^[A-Z]+$", _UP),
    (r"^[A-Za-z]+$", _UP + _LOW),
    (r"^[A-Z2-7]+$", _UP + "234567"),
    (r"^[0-9a-z]+$", _DIGITS + _LOW),
    (r"^[0-9A-Z]+$", _DIGITS + _UP),
    (r"^[A-Za-z0-9+/]+$", _UP + _LOW + _DIGITS + "+/"),
    (r"^[A-Za-z0-9_-]+$", _UP + _LOW + _DIGITS + "-_"),
)


#: Parts of a run that no encoding fits: without '=', and with the symbols of one pair or none.
PARTS = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}")
#: A class is a length class, with more for each encoding, and for parts.
ENCODING_CLASSES, PART_CLASSES = 100, 10_000


def matches(text: str | Column, pattern: str) -> Column:
    """Matches of a pattern as (start, match), leftmost first, not overlapping."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    found = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    pieces = F.split(column, pattern, -1)
    zipped = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    # Start of a match: the lengths of all pieces and matches before it.
    walked = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["p"]) + F.char_length(x["m"])).alias("at"),
            F.concat(
                s["out"],
                F.array(F.struct((s["at"] + F.char_length(x["p"])).alias("start"), x["m"].alias("match"))),
            ).alias("out"),
        ),
        lambda s: s["out"],
    )
    none = F.array().cast("array<struct<start:int,match:string>>")
    return F.when(F.rlike(column, F.lit(pattern)), walked).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (x["start"] + F.char_length(x["match"])).alias("end"),
        ),
    )


# The battery.


def _with_alphabet(found: Column) -> Column:
    """(start, end, bare, encoding, alphabet): the token without padding, and the number and
    alphabet of the narrowest encoding that fits; tokens of none, or too short without
    padding, are gone."""

    def encoding(bare: Column) -> Column:
        out = F.lit(None).cast("int")
        for number, (pattern, _) in reversed(list(enumerate(ENCODINGS))):
            out = F.when(F.rlike(bare, F.lit(pattern)), F.lit(number)).otherwise(out)
        return out

    alphabets = F.array(*[F.lit(letters) for _, letters in ENCODINGS])
    tokens = F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"),
            (x["start"] + F.char_length(x["match"])).alias("end"),
            F.regexp_replace(x["match"], "=+$", "").alias("bare"),
        ),
    )
    tokens = F.transform(
        tokens, lambda x: F.struct(x["start"], x["end"], x["bare"], encoding(x["bare"]).alias("encoding"))
    )
    fitting = F.filter(
        tokens, lambda x: x["encoding"].isNotNull() & (F.char_length(x["bare"]) >= MIN_CANDIDATE)
    )
    return F.transform(
        fitting,
        lambda x: F.struct(
            x["start"], x["end"], x["bare"], x["encoding"], F.get(alphabets, x["encoding"]).alias("alphabet")
        ),
    )


def _kinds(bare: Column) -> Column:
    """Neighbours among letters and digits, how many of them are of different kinds (one less
    than there are stretches of one kind), and whether there are letters of both cases."""
    plain = F.regexp_replace(bare, "[^A-Za-z0-9]", "")
    stretches = F.lit(0)
    for kind in ("[a-z]+", "[A-Z]+", "[0-9]+"):
        stretches = stretches + F.regexp_count(plain, F.lit(kind))
    cased = F.rlike(plain, F.lit("[a-z]")) & F.rlike(plain, F.lit("[A-Z]"))
    return F.struct(
        (F.char_length(plain) - 1).cast("double").alias("neighbours"),
        (stretches - 1).cast("double").alias("changes"),
        F.when(cased, F.lit(CASED_CHANGE)).otherwise(F.lit(TEXT_CHANGE)).alias("rate"),
    )


def _with_sums(tokens: Column) -> Column:
    """Adds k and n, the sizes of alphabet and token, squares (of the counts of its
    characters), and values (the places of its characters in the alphabet)."""

    def squares(x: Column) -> Column:
        def count(c: Column) -> Column:
            return F.char_length(x["bare"]) - F.char_length(F.replace(x["bare"], c))

        return F.aggregate(
            F.split(x["alphabet"], ""),
            F.lit(0.0),
            lambda total, c: total + F.when(c == "", F.lit(0.0)).otherwise(F.pow(count(c), F.lit(2))),
        )

    return F.transform(
        tokens,
        lambda x: F.struct(
            x["start"],
            x["end"],
            x["encoding"],
            _kinds(x["bare"]).alias("kinds"),
            F.char_length(x["alphabet"]).cast("double").alias("k"),
            F.char_length(x["bare"]).cast("double").alias("n"),
            squares(x).alias("squares"),
            F.transform(
                F.array_remove(F.split(x["bare"], ""), ""), lambda c: F.instr(x["alphabet"], c) - 1
            ).alias("values"),
        ),
    )


def _with_neighbours(tokens: Column) -> Column:
    """Adds changes (of neighbours between the alphabet's halves) and products (the sum over
    neighbours of the products of their distances from the middle)."""

    def walked(x: Column) -> Column:
        m = F.size(x["values"]) - 1
        low, middle = x["k"] / 2, (x["k"] - 1) / 2
        pairs = F.zip_with(
            F.slice(x["values"], 1, m),
            F.slice(x["values"], 2, m),
            lambda a, b: F.struct(
                ((a >= low) != (b >= low)).cast("double").alias("change"),
                ((a - middle) * (b - middle)).alias("product"),
            ),
        )
        return F.aggregate(
            pairs,
            F.struct(F.lit(0.0).alias("changes"), F.lit(0.0).alias("products")),
            lambda s, p: F.struct(
                (s["changes"] + p["change"]).alias("changes"),
                (s["products"] + p["product"]).alias("products"),
            ),
        )

    return F.transform(
        tokens,
        lambda x: F.struct(
            x["start"], x["end"], x["encoding"], x["kinds"], x["k"], x["n"], x["squares"],
            walked(x).alias("sums"),
        ),
    )


def _with_tests(tokens: Column) -> Column:
    """(start, end, length_class, bin): bin is four times the negative logarithm of the
    p-value, rounded down, and zero for tokens that fail a test of randomness."""

    def scores(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chi = k / n * x["squares"] - n
        variance = (k * k - 1) / 12
        pairs = (x["squares"] - n) / 2
        expected = F.greatest(F.lit(TEXT_MATCH), 2 / k) * n * (n - 1) / 2
        log_pairs = F.when(pairs >= expected, F.lit(0.0)).otherwise(
            pairs - expected - F.when(pairs > 0, pairs * F.log(pairs / expected)).otherwise(0.0)
        )
        neighbours, changes, rate = (x["kinds"][c] for c in ("neighbours", "changes", "rate"))
        kept = neighbours - changes
        log_changes = F.when(changes <= rate * neighbours, F.lit(0.0)).otherwise(
            -changes * F.log(changes / (neighbours * rate))
            - F.when(kept > 0, kept * F.log(kept / (neighbours * (1 - rate)))).otherwise(0.0)
        )
        return F.struct(
            x["start"],
            x["end"],
            x["encoding"],
            n.alias("n"),
            ((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("z_chi"),
            ((x["sums"]["changes"] - (n - 1) / 2) / (F.sqrt(n - 1) / 2)).alias("z_runs"),
            (x["sums"]["products"] / (variance * F.sqrt(n - 1))).alias("z_serial"),
            (-(log_pairs + log_changes)).alias("evidence"),
        )

    def judged(x: Column) -> Column:
        random = (
            (F.abs(x["z_chi"]) <= Z_LIMIT)
            & (F.abs(x["z_runs"]) <= Z_LIMIT)
            & (F.abs(x["z_serial"]) <= Z_LIMIT)
        )
        # Fisher: the p-value of two that multiply to exp(-evidence).
        combined = x["evidence"] - F.log(1 + x["evidence"])
        length = F.floor(2 * F.log2(x["n"]))
        return F.struct(
            x["start"],
            x["end"],
            (length + ENCODING_CLASSES * x["encoding"]).cast("int").alias("length_class"),
            F.when(random, F.least(F.floor(4 * combined), F.lit(MAX_BIN))).otherwise(0).cast("int").alias("bin"),
        )

    return F.transform(F.transform(tokens, scores), judged)


#: Bins of p-values; the last one holds all smaller ones.
MAX_BIN = 400


def _parts(runs: Column) -> Column:
    """(start, match) of the parts of all runs that no encoding fits."""

    def unfit(x: Column) -> Column:
        bare = F.regexp_replace(x["match"], "=+$", "")
        return ~reduce(or_, [F.rlike(bare, F.lit(pattern)) for pattern, _ in ENCODINGS])

    def parts(x: Column) -> Column:
        found = F.concat(*[matches(x["match"], pattern) for pattern in PARTS])
        return F.transform(
            F.array_distinct(found),
            lambda p: F.struct((x["start"] + p["start"]).alias("start"), p["match"].alias("match")),
        )

    return F.flatten(F.transform(F.filter(runs, unfit), parts))


def _tested(found: Column) -> Column:
    """The tests of those of (start, match) that have a letter."""
    lettered = F.filter(found, lambda x: F.rlike(x["match"], F.lit("[A-Za-z]")))
    return _with_tests(_with_neighbours(_with_sums(_with_alphabet(lettered))))


def _scanned(docs: DataFrame) -> DataFrame:
    """Adds ``_base``, the base spans in order, and ``_tokens``, the tested candidates."""
    assigned = F.filter(
        matches("text", ASSIGN),
        lambda x: F.char_length(F.regexp_extract(x["match"], ASSIGN, 2)) >= MIN_ASSIGNED,
    )
    base = F.concat(
        _spans(assigned, "assign"),
        _spans(matches("text", ACCESS), "access"),
        _spans(matches("text", HEX), "hex"),
    )
    with_runs = docs.withColumns({"_base": F.array_sort(base), "_runs": matches("text", CANDIDATE)})
    parts = F.transform(
        _tested(_parts(F.col("_runs"))),
        lambda x: x.withField("length_class", x["length_class"] + PART_CLASSES),
    )
    tested = F.concat(_tested(F.col("_runs")), parts)
    # Most texts have no run, and nothing to test.
    none = F.filter(tested, lambda _: F.lit(False))
    return with_runs.withColumn("_tokens", F.when(F.size("_runs") > 0, tested).otherwise(none)).drop("_runs")


def cuts(tokens: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """(length_class, cut): the least bin that is found in each class, by the step-up rule
    over all tokens (length_class, bin).  At most some sixty rows for each encoding, and as
    many for parts: lengths by half powers of two; what is counted has at most MAX_BIN + 1
    rows for each."""
    counts = tokens.groupBy("length_class", "bin").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("length_class")
    above = by_class.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns(
        {"rank": F.sum("n").over(above), "all": F.sum("n").over(by_class)}
    )
    # Every p-value of a bin is at most exp(-bin / 4).
    passing = ranked.where(
        (F.col("bin") > 0) & (F.exp(-F.col("bin") / 4) <= F.col("rank") * rate / F.col("all"))
    )
    return passing.groupBy("length_class").agg(F.min("bin").alias("cut"))


def _with_spans(scanned: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds ``_spans``: base spans, and found tokens that overlap none of them and are inside
    no other found one, in order."""
    # Some hundred rows, as a constant of the plan.
    pairs = [F.lit(value) for row in cut.collect() for value in (row.length_class, row.cut)]
    least = F.create_map(*pairs) if pairs else F.lit(None).cast("map<int,int>")
    found = F.filter(
        "_tokens",
        lambda x: (x["bin"] >= F.coalesce(F.try_element_at(least, x["length_class"]), F.lit(MAX_BIN + 1)))
        & ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    with_found = scanned.withColumn("_found", found)
    outer = F.filter(
        "_found",
        lambda x: ~F.exists(
            "_found",
            lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])
            & ((y["end"] - y["start"]) > (x["end"] - x["start"])),
        ),
    )
    added = F.transform(
        outer,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")
        ),
    )
    return with_found.withColumn("_spans", F.array_sort(F.concat("_base", added))).drop("_found")


def _text_of(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
        ),
        ",",
    )


def scan(docs: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every row."""
    rows = stored(_scanned(docs.select("doc_id", "text")).drop("text"), "scanned")
    tokens = rows.select(F.explode("_tokens").alias("t")).select("t.length_class", "t.bin")
    spanned = _with_spans(rows, cuts(tokens, rate))

    def number(kind: str) -> Column:
        wanted = KINDS.index(kind)
        return F.size(F.filter("_spans", lambda x: x["kind"] == wanted)).cast("long")

    return spanned.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_text_of("_base"), 256).alias("base_sha256"),
        _text_of("_spans").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "<secret>", rate: float = DISCOVERY_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, with ``mark`` in place of every secret; spans that
    touch each other get one mark.  Rows without secrets stay as they are.  The secrets are
    those of ``scan``; texts are scanned once, and written with what was found."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text"))
    scanned = stored(_scanned(rows).drop("text"), "scanned")
    tokens = scanned.select(F.explode("_tokens").alias("t")).select("t.length_class", "t.bin")
    spanned = _with_spans(scanned.withColumn("text", F.col("_row.text")), cuts(tokens, rate))
    cutting = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(
                (x["start"] > s["at"]) | (s["out"] == ""),
                F.concat(s["out"], F.substr("text", s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.lit(mark)),
            ).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substr("text", s["at"] + 1, F.char_length("text"))),
    )
    text = F.when(F.size("_spans") > 0, cutting).otherwise(F.col("text"))
    return spanned.withColumn("text", text).select("_row", "text").select(
        *[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    )
