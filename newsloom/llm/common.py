"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import ship
from newsloom.sources.storage import settled

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, for the registered queries."""
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def is_held_out(key: str, modulus: int, which: int) -> Column:
    """Whether a row belongs to the held-out fold; a row without a key does not."""
    return F.coalesce(remainder(key, modulus) == which, F.lit(False))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: cuts the lineage, and
    survives the loss of executors.  The folder goes when the application ends."""
    return settled(df, label)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets; NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    n, wide = len(column), pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_steps(
    batches: Iterator[pa.RecordBatch], text: str, step_bytes: int = STEP_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches holding about ``step_bytes`` of text each, with its bytes and
    offsets.  Bounds the memory of whatever numpy does with them, however long texts are."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = string_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + step_bytes, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            first, last = offsets[row], offsets[end]
            yield batch.slice(row, end - row), data[first:last], offsets[row : end + 1] - first
            row = end


def hashed_limit(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same in every run: those with the smallest hashes of the key.

    The rows are counted first, so that only about as many as are wanted reach the sort."""
    n = df.count()
    order = F.xxhash64(F.col(key).cast("string"))
    if n > 2 * rows:
        share = min(1.0, 1.2 * rows / n + 1e-9)
        df = df.where(order < int(-(2**63) + share * 2**64))
    return df.orderBy(order, key).limit(rows)


def row_sample(df: DataFrame, content: Column, rows: int) -> DataFrame:
    """At most ``rows`` of the different (doc_id, content), the same in every run: those with
    the smallest hashes, so that an id of many rows takes its share only; in order of ids."""
    different = df.withColumn("_content", F.xxhash64(content)).dropDuplicates(["doc_id", "_content"])
    sample = different.orderBy(F.xxhash64("doc_id", "_content"), "doc_id").limit(rows)
    return sample.orderBy("doc_id", "_content").drop("_content")


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """One row (doc_id, label) for each labelled document outside the held-out fold of the
    contracts (crc32 modulo 4 is 2).  Rows without id or label are no labels; the largest
    of several counts."""
    usable = F.col("doc_id").isNotNull() & F.col(label).isNotNull()
    rows = labels.where(usable & ~is_held_out("doc_id", 4, 2))
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
