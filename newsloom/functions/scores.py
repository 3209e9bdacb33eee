"""Relevance (SF3) and significance (SF4) scores as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: BM25 parameters and the stored-length code -----------------
K1, B = 1.2, 0.75
# A row length is stored in one byte: exact below EXACT_LENGTHS, above that the
# part over LENGTH_OFFSET keeps its four leading binary digits.
EXACT_LENGTHS, LENGTH_OFFSET, KEPT_DIGITS = 40, 24, 4
# -------------------------------------------------------------------------------


def inverse_document_frequency(n_docs: Column, doc_freq: Column) -> Column:
    return F.log(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5))


def stored_length(length: Column) -> Column:
    """Row length as the one-byte norm of the search store remembers it."""
    over = length - LENGTH_OFFSET
    dropped = F.length(F.bin(over.cast("bigint"))) - KEPT_DIGITS
    kept = F.call_function("shiftleft", F.call_function("shiftright", over, dropped), dropped)
    return F.when(length < EXACT_LENGTHS, length).otherwise(LENGTH_OFFSET + kept)


def term_score(weight: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    """BM25 contribution of one term; ``weight`` is idf times query repetitions."""
    norm = K1 * ((1 - B) + B * stored_length(length) / mean_length)
    return (K1 + 1) * weight * tf / (tf + norm)


def highest_score(weight: Column, max_tf: Column, least_ratio: Column, mean_length: Column) -> Column:
    """At least ``term_score`` of any row with tf up to ``max_tf`` and (stored) length / tf
    from ``least_ratio`` on."""
    return (K1 + 1) * weight / (1 + K1 * (1 - B) / max_tf + K1 * B * least_ratio / mean_length)


def significance(fg_count: Column, fg_size: Column, bg_count: Column, bg_size: Column) -> Column:
    """JLH score: absolute times relative change of a word's frequency."""
    fp, bp = fg_count / fg_size, bg_count / bg_size
    return F.when(fp > bp, (fp - bp) * (fp / bp)).otherwise(F.lit(0.0))
