"""Quality rules: boosted trees over document statistics, monotone in what marks junk.

A document is kept if it passes the base rules (enough words, few repeated windows) and
the trees give it at least ``KEEP_SCORE``.  The trees' score never rises as the share of
symbols, repeated lines or repeated windows grows.

Defined results: a NULL or empty text has no words and fails the base rules; a document
without id is judged by its text like any other, but is no training row; repeated rows
are judged one by one and alike; without labels, or with one class only, the trees give
every text the labels' mean (0.5 without any); other columns are ignored, and kept by
``keep``.  Texts are taken whole, ``common.STEP_BYTES`` of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm import common, quality, statistics, trees

KEEP_SCORE = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Features whose growth may not raise the score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "dup_line_bytes")


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = quality.MAX_TRAINING_ROWS
) -> trees.Forest:
    """Trees fitted on ``labels.quality`` of at most ``max_rows`` documents."""
    x, y = quality.training_rows(docs, labels, "quality", max_rows)
    signs = [-1 if name in FALLING else 0 for name in statistics.FEATURES]
    return trees.fit(x, y, monotone=signs, trees=60, depth=3)


def verdicts(data: np.ndarray, offsets: np.ndarray, forest: trees.Forest) -> dict[str, np.ndarray]:
    base, x = statistics.measure(data, offsets)
    words, repeats = base["n_words"], base["n_repeat_words"]
    failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    score = forest.score(x)
    kept = ~failed & (score >= KEEP_SCORE)
    return {**base, "base_failed": failed, "kept": kept, "score": score}


def judge(docs: DataFrame, forest: trees.Forest) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every row of ``docs``."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(batches, "text"):
            columns = {"doc_id": batch.column("doc_id")}
            for name, values in verdicts(data, offsets, forest).items():
                columns[name] = pa.array(values)
            yield pa.RecordBatch.from_pydict(columns)

    counts = ", ".join(f"{name} long" for name in statistics.BASE)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").mapInArrow(judged, schema)


def keep(docs: DataFrame, forest: trees.Forest) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(batches, "text"):
            yield batch.filter(pa.array(verdicts(data, offsets, forest)["kept"]))

    return docs.mapInArrow(kept, docs.schema)
