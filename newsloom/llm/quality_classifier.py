"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are flat arrays, and all rows of a batch go down all trees together.  Only the
text is looked at.

Defined results: NULL and empty texts have statistics of zero and get a score like any
other; rows without id are scored, not held out and never learnt from; repeated rows get
equal scores; without labels every score is 0.5, with one class only it is close to that
class; other columns are ignored.  Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common, quality, statistics, trees

THRESHOLD = 0.7


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = quality.MAX_TRAINING_ROWS
) -> trees.Forest:
    """Trees fitted on ``labels.quality`` of at most ``max_rows`` documents outside the
    held-out fold."""
    x, y = quality.training_rows(docs, labels, "quality", max_rows)
    return trees.fit(x, y, trees=120, depth=4, rate=0.1)


def score(docs: DataFrame, forest: trees.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(batches, "text"):
            _, x = statistics.measure(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(forest.score(x))],
                ["doc_id", "held_out", "score"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", common.is_held_out("doc_id", 4, 2).alias("held_out"), "text")
    scores = rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")
    return scores.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
