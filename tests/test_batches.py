"""Terms counted and grouped on Arrow batches, against plain Python."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import batches
from newsloom.operators import postings as term_tables

TOKENS = [["b", "a", "b"], [], None, ["é", "z", "é", "a"], ["a"] * 9, ["\U0001f600", "z", "￮"]]
IDS = [7, 8, 9, None, 5, 1 << 40]
FIELDS = ["x", "x", "y", "y", "x", "y"]


def tokens_batch():
    types = [pa.string(), pa.int64(), pa.list_(pa.string())]
    columns = [pa.array(values, kind) for values, kind in zip((FIELDS, IDS, TOKENS), types)]
    return pa.RecordBatch.from_arrays(columns, ["field", "doc_id", "tokens"])


@pytest.mark.parametrize("step", [1, 4, 1 << 21])
def test_counted_blocks_and_records(monkeypatch, step):
    monkeypatch.setattr(batches, "STEP", step)
    rows = list(batches.counted([tokens_batch()]))
    found = [row for batch in rows for row in batch.to_pylist()]
    for row, field, doc_id, tokens in zip(found, FIELDS, IDS, TOKENS, strict=True):
        counts = sorted(Counter(tokens or []).items(), key=lambda count: count[0].encode())
        assert (row["field"], row["doc_id"], row["length"]) == (field, doc_id, None if tokens is None else len(tokens))
        assert list(zip(row["terms"], row["tfs"], strict=True)) == counts
    made = list(batches.blocks([pa.Table.from_batches(rows).combine_chunks().to_batches()[0]]))
    bucketed = [b.append_column("bucket", pa.array([3] * len(b), pa.int32())) for b in made]
    postings = [tuple(row.values()) for batch in batches.records(bucketed) for row in batch.to_pylist()]
    expected = Counter(
        (field, 3, term, doc_id, tokens.count(term), len(tokens), term == min(tokens, key=str.encode))
        for field, doc_id, tokens in zip(FIELDS, IDS, TOKENS)
        for term in set(tokens or [])
    )
    assert Counter(postings) == expected
    if step > 4:
        least = {(row["field"], row["term"]): row["least"] for b in made for row in b.to_pylist()}
        assert least["x", "a"] == 5 and least["y", "z"] is None and len(least) == sum(map(len, made))


def test_sorted_keys_keep_the_order_of_equal_ones():
    keys = batches.np.array([3, 1, 3, 0, 1])
    for n_keys in (4, 1 << 61):
        ordered, order = batches._sorted(keys, n_keys)
        assert ordered.tolist() == [0, 1, 1, 3, 3] and order.tolist() == [3, 1, 4, 0, 2]


def test_postings_are_dealt_in_blocks_and_stay_in_order(spark, tmp_path, monkeypatch):
    dealt = []
    kept = term_tables.TermTables.writer
    monkeypatch.setattr(
        term_tables.TermTables, "writer", staticmethod(lambda rows, *names: dealt.append(rows) or kept(rows, *names))
    )
    texts = F.concat_ws(" ", F.lit("hot"), F.concat(F.lit("w"), F.col("id") % 7))
    rows = spark.range(0, 5000, numPartitions=2).select(F.col("id").alias("doc_id"), texts.alias("text"))
    term_tables.write_term_tables(rows, str(tmp_path), ("text",), n_buckets=1)
    plan = dealt[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow records") < plan.index("RebalancePartitions") < plan.index("MapInArrow blocks")
    entries = term_tables.read_term_table(spark, str(tmp_path), term_tables.POSTINGS)
    assert entries.count() == 10_000
    files = entries.groupBy(F.input_file_name()).agg(F.collect_list(F.struct("term", "doc_id")).alias("all"))
    assert all(row["all"] == sorted(row["all"]) for row in files.collect())
