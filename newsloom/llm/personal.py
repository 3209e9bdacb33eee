"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust them.

Patterns of the kinds ``email``, ``ip``, ``card`` and ``phone`` give the base spans: leftmost
matches that do not overlap within their kind, of which those that fail the check of their
kind (parts up to 255, Luhn, number of digits) are dropped.  The method adds the kinds
``iban`` (confirmed by the remainder 1 modulo 97), ``ssn`` and ``local``, a telephone number
without its country.  Every span has a score, in hundredths: that of its kind, more for a
passed checksum and for a supporting word of its kind nearby, less for an opposing word.  A
span of an added kind is reported from a score of ``LEAST`` on and if it overlaps no base
span and no span of an added kind before it in ``KINDS``; base spans are reported whatever
their score.

A NULL or empty text has no spans; texts are read whole, in time that grows with their
length; rows are judged one by one, so that repeated rows and ids get equal results, rows
without an id are judged too, and an empty table gives an empty one.  Columns other than
doc_id and text are not read; ``redact`` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: kinds, patterns, words and scores -----------------------------
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local")
#: What a span of a kind scores, in hundredths.
PRIOR = {"email": 80, "ip": 60, "card": 50, "phone": 60, "iban": 40, "ssn": 40, "local": 40}
CHECKSUM, SUPPORT, OPPOSED, LEAST = 30, 20, -30, 60
SUPPORTING = {
    "email": "email|mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|server|host|client|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|contact|telefon|handy|telefono",
    "iban": "iban|account|bank|swift|bic|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
    "local": "phone|tel|telephone|call|mobile|cell|fax|contact|telefon|handy|telefono",
}
OPPOSING = "example|sample|dummy|version|release|section|isbn|order|invoice|tracking|serial"
#: Code points before and behind a span in which such words count.
BEFORE, BEHIND = 40, 20
#: Patterns of the added kinds.
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
LOCAL = r"\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}\b|\b[0-9]{3}[-.\x20][0-9]{3}[-.\x20][0-9]{4}\b"
# ---------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where its digits begin, so that no digit is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ADDED = {kind: re.compile(p, re.A) for kind, p in (("iban", IBAN), ("ssn", SSN), ("local", LOCAL))}
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_WORDS = {k: re.compile(f"[^a-z0-9_](?:{w})[^a-z0-9_]") for k, w in SUPPORTING.items()}
_OPPOSING = re.compile(f"[^a-z0-9_](?:{OPPOSING})[^a-z0-9_]")


@dataclass(frozen=True)
class Span:
    """A span of a text in code points, its end exclusive, and its score in hundredths."""

    kind: str
    start: int
    end: int
    score: int

    @property
    def is_base(self) -> bool:
        return self.kind in BASE_KINDS


def passes_luhn(digits: str) -> bool:
    doubled = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def remainder_97(account: str) -> int:
    """Of an account number without spaces, its first four characters moved to the end and
    letters counted from 10."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from the at signs, so that a long word without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_PART:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 16:
            continue
        digits = _NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and passes_luhn(digits):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()


def _confirmed(kind: str, found: str) -> bool:
    if kind == "iban":
        account = found.replace(" ", "")
        return 15 <= len(account) <= 34 and remainder_97(account) == 1
    if kind == "ssn":
        area, group, serial = found.split("-")
        return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"
    return True


def _score(text: str, kind: str, start: int, end: int) -> int:
    """The kind's own, adjusted; words count whole, also at the edges of what is looked at."""
    first, last = start - BEFORE - 1, end + BEHIND + 1
    before = text[first:start] if first >= 0 else " " + text[:start]
    behind = text[end:last] if last <= len(text) else text[end:] + " "
    # Only these letters are folded: other alphabets' folding may change a text's length.
    near = f"{before} {behind}".encode().lower().decode()
    score = PRIOR[kind] + (CHECKSUM if kind in ("card", "iban") else 0)
    score += SUPPORT if _WORDS[kind].search(near) else 0
    return score + (OPPOSED if _OPPOSING.search(near) else 0)


def spans_of(text: str | None, least: int = LEAST) -> list[Span]:
    """All spans of a text, by kind as in ``KINDS``, then by start."""
    text = text or ""
    spans = [Span(kind, a, b, _score(text, kind, a, b)) for kind, a, b in _base_spans(text)]
    if not _DIGIT.search(text):
        return spans
    for kind, pattern in _ADDED.items():
        added = []
        for m in pattern.finditer(text):
            a, b = m.span()
            if not _confirmed(kind, m[0]) or any(s.start < b and a < s.end for s in spans):
                continue
            score = _score(text, kind, a, b)
            if score >= least:
                added.append(Span(kind, a, b, score))
        spans += added
    return spans


def masked(text: str, spans: list[Span]) -> str:
    """The text with the name of its kind in place of each span, ``<email>``; of spans that
    overlap, one mark, of the first."""
    out, end = [], 0
    for span in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind))):
        if span.start >= end:
            out += [text[end : span.start], f"<{span.kind}>"]
        end = max(end, span.end)
    return "".join([*out, text[end:]])


_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int64()), ("is_base", pa.bool_())]
)


def find(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end, score, is_base)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [{**vars(s), "is_base": s.is_base} for s in spans_of(t.as_py(), least)]
                for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "spans"]
            )

    rows = docs.select("doc_id", F.col(text).alias("text"))
    span = "struct<kind: string, start: bigint, end: bigint, score: bigint, is_base: boolean>"
    return rows.mapInArrow(found, f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<{span}>")


def redact(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the spans of ``text`` masked; a NULL stays NULL."""

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = (t.as_py() for t in batch.column(at))
            new = [None if t is None else masked(t, spans_of(t, least)) for t in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(cleaned, docs.schema)


def _listed(spans: Column) -> Column:
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(shown, ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: number of base spans by kind and of added ones, the digest of
    the base spans, all spans, and their scores."""
    base = F.filter("spans", lambda s: s["is_base"])
    counts = [
        F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
        for kind in KINDS
    ]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return find(docs).select(
        "doc_id",
        *counts,
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        scores.alias("scores"),
    )
