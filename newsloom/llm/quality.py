"""What the two classifiers over document statistics share: fitting, and passing over texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common, statistics, trees

#: Labelled rows a classifier is fitted on at most.
MAX_TRAINING_ROWS = 20_000


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, max_rows: int
) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and labels of at most ``max_rows`` labelled documents, the same in
    every run.  The sample of ids is small by that bound, and is broadcast."""
    sample = common.hashed_limit(common.labelled(labels, label), "doc_id", max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    width = len(statistics.FEATURES)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(batches, "text"):
            _, x = statistics.measure(data, offsets)
            columns = [batch.column("doc_id"), batch.column("label")]
            features = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width)
            yield pa.RecordBatch.from_arrays(
                [*columns, features.cast(pa.list_(pa.float64()))], ["doc_id", "label", "x"]
            )

    kind = dict(texts.dtypes)["doc_id"]
    rows = texts.mapInArrow(measured, f"doc_id {kind}, label int, x array<double>")
    # Repeated ids can make it more rows than ids; the order makes the fit repeatable.
    found = common.row_sample(rows, F.col("x"), max_rows).toArrow()
    x = np.asarray(found.column("x").combine_chunks().flatten(), float).reshape(-1, width)
    return x, np.asarray(found.column("label"), float)
