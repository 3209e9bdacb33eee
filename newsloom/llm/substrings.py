"""Removal of long repeated substrings, with suffix arrays built one bucket at a time.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere goes.  Such
strings are windows; ``anchors`` puts equal ones into one bucket and keeps neighbouring
ones together as contexts.  What few bytes say is settled by counting: a bucket met once
has no repeats, and a context met twice repeats whole.  Only where a bucket has different
contexts, one copy of each is fetched, and their suffixes are sorted by ``suffixes``, in
blocks of ``BLOCK_BYTES`` at most.  A bucket with more than ``CONTEXTS`` of them (a passage
in many surroundings) is cut into finer ones, down to single windows, and settled likewise.
Rows of a context that is met very often stay where they are: such contexts are few, and are
broadcast.

Counting uses 128 bits of hashes for equality of contexts; sorted windows are compared
byte for byte.  Nothing is collected; the text is shuffled by row for fetching contexts and
for the removal.

Defined results: NULL and empty texts have no bytes; texts shorter than a window lose
nothing; repeated rows are occurrences of each other and lose all windows; rows without id
are texts like others; other columns are ignored.  Texts are taken whole; one that is
longer than ``SEGMENT`` is read in overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import anchors, common, suffixes
from newsloom.llm import octets as o

LENGTH = 400
#: Offsets of a block of windows, and what crowded buckets are cut into; those above a third
#: of the length are left out.
GROUPS = (128, 16, 2, 1)
CONTEXTS = 1_024
BLOCK_BYTES = 1 << 18
#: Contexts met more than HOT_ROWS times, and more often than one row in HOT_CONTEXTS is, are
#: broadcast: fewer than HOT_CONTEXTS.
HOT_ROWS = 4_096
HOT_CONTEXTS = 10_000
SEGMENT = 1 << 20
STEP_BYTES = 1 << 18

ROW = ["k1", "k2"]
BUCKET = ["core", "context"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with 128 bits for the row; rows with one id and text are alike."""
    return docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("doc_id").alias("k1"),
        F.xxhash64("text").alias("k2"),
    )


def groups_for(length: int) -> tuple[int, ...]:
    if length < 2 * anchors.GRAM:
        raise ValueError(f"the length must be at least {2 * anchors.GRAM}")
    return tuple(g for g in GROUPS if g <= length // 3)


def _segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """The step whole, or a long text in segments that share all but one byte of a window;
    with the place where each begins in its text."""
    if len(data) <= 2 * SEGMENT or len(offsets) > 2:
        yield data, offsets, 0
        return
    for start in range(0, len(data), SEGMENT):
        part = data[start : start + SEGMENT + length - 1]
        yield part, np.array([0, len(part)]), start


def context_rows(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, first, last, anchor, core, context): the contexts of all texts; windows start
    from byte ``first`` to ``last``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(batches, "text", STEP_BYTES):
            k1, k2 = (np.asarray(batch.column(c)) for c in ROW)
            for part, bounds, start in _segments(data, offsets, length):
                row, first, last, anchor, core, context = anchors.blocks(part, bounds, length, groups_for(length)[0])
                base = bounds[row] - start
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k1[row]),
                        pa.array(k2[row]),
                        *[pa.array(x - base) for x in (first, last, anchor)],
                        *[pa.array(x.view(np.int64)) for x in (core, context)],
                    ],
                    [*ROW, "first", "last", "anchor", *BUCKET],
                )

    schema = "k1 long, k2 long, first long, last long, anchor long, core long, context long"
    return docs.select(*ROW, "text").mapInArrow(found, schema)


def _spans(rows: DataFrame, length: int) -> DataFrame:
    return rows.select(*ROW, F.col("first").alias("begin"), (F.col("last") + length).alias("end"))


def _repeated(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """The rows whose context is met more than once, by its ``n`` in ``contexts``."""
    total = contexts.agg(F.sum("n").alias("n")).first().n or 0
    hot = F.col("n") > max(HOT_ROWS, total // HOT_CONTEXTS)
    often = F.broadcast(contexts.where(hot).select(*BUCKET))
    twice = contexts.where((F.col("n") > 1) & ~hot).select(*BUCKET)
    others = rows.join(often, BUCKET, "left_anti").join(twice, BUCKET, "left_semi")
    return rows.join(often, BUCKET, "left_semi").unionByName(others)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, begin, end): bytes of the rows of ``docs`` (keyed) covered by repeats; the
    spans may overlap."""
    every = common.stored(context_rows(docs, length), "contexts")
    # Most buckets are met once; their contexts go before anything wide is shuffled.
    # Written, so that the join after it reads plain shuffles, which are split if a bucket
    # holds very many rows.
    again = every.groupBy("core").agg(F.count("*").alias("met")).where("met > 1").select("core")
    again = common.stored(again, "buckets")
    rows = common.stored(every.join(again, "core", "left_semi").select(*every.columns), "met-again")
    one = F.min(F.struct(*ROW, "first", "last", "anchor")).alias("one")
    contexts = common.stored(
        rows.groupBy(*BUCKET).agg(F.count("*").alias("n"), one), "different-contexts"
    )
    spans = _spans(_repeated(rows, contexts), length)

    several = contexts.groupBy("core").agg(F.count("*").alias("contexts")).where("contexts > 1")
    several = common.stored(several, "several")
    open_rows = contexts.join(several, "core").select(*BUCKET, "n", "contexts", "one.*")
    size = F.col("last") - F.col("first") + length
    texts = docs.select(*ROW, F.col("text").cast("binary").alias("bytes"))
    piece = F.substring(F.col("bytes"), (F.col("first") + 1).cast("int"), size.cast("int"))
    fetched = open_rows.join(texts, ROW).select(
        *BUCKET, "n", "contexts", *ROW, "first", "last", "anchor", piece.alias("part")
    )
    # Rows with one key are alike, and bring the same part.
    fetched = common.stored(fetched.dropDuplicates(BUCKET), "fetched")
    return spans.unionByName(_settled(fetched, length, groups_for(length)[1:]))


def _settled(rows: DataFrame, length: int, groups: tuple[int, ...]) -> DataFrame:
    """Spans of the contexts (met once: n = 1) whose windows repeat in other contexts."""
    spans = _sorted(rows.where(F.col("contexts") <= CONTEXTS), length)
    crowded = rows.where(F.col("contexts") > CONTEXTS)
    if not groups or crowded.isEmpty():
        return spans
    finer = common.stored(_cut(crowded, length, groups[0]), "finer")
    one = F.first(F.struct(*ROW, "first", "last", "anchor", "part")).alias("one")
    contexts = finer.groupBy(*BUCKET).agg(F.sum("n").alias("n"), one)
    contexts = common.stored(contexts, "finer-contexts")
    # Rows that stand for several are spans already.
    spans = spans.unionByName(_spans(_repeated(finer.where("n = 1"), contexts), length))
    several = contexts.groupBy("core").agg(F.count("*").alias("contexts")).where("contexts > 1")
    several = common.stored(several, "finer-several")
    rest = contexts.join(several, "core").select(*BUCKET, "n", "contexts", "one.*")
    rest = common.stored(rest.select(*rows.columns), "crowded")
    return spans.unionByName(_settled(rest, length, groups[1:]))


_PART = (
    "core long, context long, n long, k1 long, k2 long, first long, last long, anchor long, part binary"
)


def _cut(rows: DataFrame, length: int, group: int) -> DataFrame:
    """The contexts again, with at most ``group`` offsets each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(_binary_as_text(batches), "part", STEP_BYTES):
            first, last, anchor = (np.asarray(batch.column(c)) for c in ("first", "last", "anchor"))
            windows = last - first + 1
            row = np.repeat(np.arange(len(first)), windows)
            start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            start = start + offsets[row]
            owner = (anchor - first)[row] + offsets[row]
            at, begin, end, _, core, context = anchors.block_runs(data, start, owner, row, length, group)
            base = first[at] - offsets[at]
            parts = [data[b : e + length].tobytes() for b, e in zip(begin.tolist(), end.tolist())]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(core.view(np.int64)),
                    pa.array(context.view(np.int64)),
                    *[batch.column(c).take(take) for c in ("n", *ROW)],
                    pa.array(begin + base),
                    pa.array(end + base),
                    batch.column("anchor").take(take),
                    pa.array(parts, pa.binary()),
                ],
                [*BUCKET, "n", *ROW, "first", "last", "anchor", "part"],
            )

    return rows.select("n", *ROW, "first", "last", "anchor", "part").mapInArrow(cut, _PART)


def _binary_as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Binary columns have the layout of strings."""
    for batch in batches:
        at = batch.schema.get_field_index("part")
        part = batch.column(at)
        part = part.fill_null(b"") if part.null_count else part
        columns = batch.columns
        kind = pa.large_string() if pa.types.is_large_binary(part.type) else pa.string()
        columns[at] = pa.Array.from_buffers(kind, len(part), part.buffers(), offset=part.offset)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _sorted(rows: DataFrame, length: int) -> DataFrame:
    """Spans of windows found repeated by sorting the suffixes of each bucket."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _bucket_blocks(batches):
            yield _repeats(block, length)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("core", "n", *ROW, "first", "last", "anchor", "part")
    dealt = dealt.repartition(parts, "core").sortWithinPartitions("core")
    return dealt.mapInArrow(settled, "k1 long, k2 long, begin long, end long")


def _bucket_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole buckets together, up to about ``BLOCK_BYTES`` of text; a bucket is no larger."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            held.append(batch.slice(at, 512))
            if sum(b.column("part").nbytes for b in held) >= BLOCK_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                core = np.asarray(table.column("core"))
                change = np.flatnonzero(core[1:] != core[:-1]) + 1
                if len(change):
                    yield table.slice(0, change[-1])
                    table = table.slice(change[-1])
                held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _repeats(block: pa.Table, length: int) -> pa.RecordBatch:
    first, last, anchor, core, n = (
        np.asarray(block.column(c)) for c in ("first", "last", "anchor", "core", "n")
    )
    parts = block.column("part").to_pylist()
    # Anchors at places with residue zero: windows that can be equal have equal residues.
    places, end = np.zeros(len(parts), np.int64), 0
    for i, part in enumerate(parts):
        places[i] = end + (first[i] - anchor[i] - end) % suffixes.COVER
        end = places[i] + len(part)
    text = np.zeros(end, np.uint8)
    for place, part in zip(places.tolist(), parts):
        text[place : place + len(part)] = np.frombuffer(part, np.uint8)
    windows = last - first + 1
    row = np.repeat(np.arange(len(parts)), windows)
    step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    bucket = np.append(0, np.cumsum(core[1:] != core[:-1]))[row]
    again = suffixes.repeated(text, places[row] + step, bucket, length)
    again &= n[row] == 1  # contexts met more often are gone already
    begin, stop, at = o.runs(again, np.append(0, np.cumsum(windows)))
    columns = [np.asarray(block.column(c))[at] for c in ROW]
    start = first[at] + step[begin]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (*columns, start, start + (stop - begin) - 1 + length)],
        [*ROW, "begin", "end"],
    )


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(batches, "text"):
            cut = [kept(data[a:b], s) for a, b, s in zip(offsets[:-1], offsets[1:], batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(offsets) - [len(c[0]) for c in cut], pa.int64()),
                    pa.array([c[1] for c in cut], pa.int64()),
                    pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_spans(docs, length).mapInArrow(removed, schema)


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, length)
    each: Column = F.collect_set(F.struct("begin", "end"))
    by_row = spans.groupBy(*ROW).agg(each.alias("spans"))
    return keyed.join(by_row, ROW, "left").select("doc_id", "text", "spans")


def kept(data: np.ndarray, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal runs of bytes inside."""
    if not spans:
        return data.tobytes(), 0
    steps = np.zeros(len(data) + 1, np.int64)
    for span in spans:
        steps[span["begin"]] += 1
        steps[span["end"]] -= 1
    inside = np.cumsum(steps)[:-1] > 0
    return data[~inside].tobytes(), len(o.runs(inside, np.array([0, len(data)]))[0])
