"""Terms counted and grouped for many rows at once, on Arrow batches in numpy.

These are the steps inside the tasks that write the term tables; Spark deals, sorts and
writes what they make.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Tokens, or records of postings, that one numpy step works on; a longer row is a step of its own.
STEP = 1 << 21
# One posting in a block; a mark says that it is the first of its row, or that the row has no id.
ENTRY = np.dtype([("doc_id", "<i8"), ("tf", "<i4"), ("length", "<i4"), ("marks", "u1")])
FIRST, NO_ID = 1, 2

COUNTED = "field string, doc_id bigint, terms array<string>, tfs array<int>, length int"
BLOCKS = "field string, term string, least bigint, entries binary"
RECORDS = "field string, bucket int, term string, doc_id bigint, tf int, length int, is_first boolean"


def _steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` together, at least one row each."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
        yield start, stop
        start = stop


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the rows of a list column, NULL being empty, and all values end to end."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes, dtype=np.int64)), lists.flatten()


def _ranked(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings in order, and the place of each string among them."""
    found = strings.dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return found.dictionary.take(order), place[found.indices.to_numpy(zero_copy_only=False)]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return np.flatnonzero(first)


def _sorted(keys: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and where each was, equal ones in their order; quicker than ``argsort``."""
    if n_keys * len(keys) >= 1 << 61:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    bits = len(keys).bit_length()
    placed = keys << bits | np.arange(len(keys))
    placed.sort()
    return placed >> bits, placed & ((1 << bits) - 1)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``COUNTED`` of ``field, doc_id, tokens``: the distinct tokens of each row, in order, and
    the number of each."""
    for batch in batches:
        tokens = batch.column("tokens")
        offsets, values = _parts(tokens)
        lengths = pc.list_value_length(tokens).cast(pa.int32())
        for low, high in _steps(np.diff(offsets), STEP):
            bounds = offsets[low : high + 1] - offsets[low]
            names, codes = _ranked(values.slice(offsets[low], bounds[-1]))
            keys = np.repeat(np.arange(high - low), np.diff(bounds)) * max(len(names), 1) + codes
            keys.sort()
            starts = _starts(keys)
            row, code = np.divmod(keys[starts], max(len(names), 1))
            places = np.append(0, np.cumsum(np.bincount(row, minlength=high - low))).astype(np.int32)
            tfs = np.diff(starts, append=len(keys)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("field").slice(low, high - low),
                    batch.column("doc_id").slice(low, high - low),
                    pa.ListArray.from_arrays(places, names.take(pa.array(code))),
                    pa.ListArray.from_arrays(places, pa.array(tfs)),
                    lengths.slice(low, high - low),
                ],
                ["field", "doc_id", "terms", "tfs", "length"],
            )


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``BLOCKS`` of ``COUNTED``: the postings of one term in neighbouring rows are one record,
    with their least id (NULL if a row has none)."""
    for batch in batches:
        offsets, values = _parts(batch.column("terms"))
        _, tfs = _parts(batch.column("tfs"))
        ids = batch.column("doc_id")
        no_id = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        lengths = batch.column("length").fill_null(0).to_numpy(zero_copy_only=False)
        fields, field = _ranked(batch.column("field"))
        for low, high in _steps(np.diff(offsets), STEP):
            bounds = offsets[low : high + 1] - offsets[low]
            if bounds[-1] == 0:
                continue
            names, codes = _ranked(values.slice(offsets[low], bounds[-1]))
            row = np.repeat(np.arange(low, high), np.diff(bounds))
            entries = np.empty(len(row), ENTRY)
            entries["doc_id"], entries["length"], entries["marks"] = ids[row], lengths[row], no_id[row] * NO_ID
            entries["tf"] = tfs.slice(offsets[low], bounds[-1]).to_numpy(zero_copy_only=False)
            entries["marks"][bounds[:-1][np.diff(bounds) > 0]] |= FIRST
            keys, order = _sorted(field[row] * len(names) + codes, len(fields) * len(names))
            entries = entries[order]
            starts = _starts(keys)
            of_field, of_term = np.divmod(keys[starts], len(names))
            missing = np.bitwise_or.reduceat(entries["marks"], starts) & NO_ID > 0
            places = np.append(starts, len(keys)) * ENTRY.itemsize
            yield pa.RecordBatch.from_arrays(
                [
                    fields.take(pa.array(of_field)),
                    names.take(pa.array(of_term)),
                    pa.array(np.minimum.reduceat(entries["doc_id"], starts), mask=missing),
                    pa.Array.from_buffers(
                        pa.binary(),
                        len(starts),
                        [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(entries)],
                    ),
                ],
                ["field", "term", "least", "entries"],
            )


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``RECORDS`` of ``BLOCKS`` with their ``bucket``: one record a posting."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("entries")).to_numpy(zero_copy_only=False) // ENTRY.itemsize
        for low, high in _steps(sizes, STEP // 4):
            part = batch.slice(low, high - low)
            entries = np.frombuffer(b"".join(part.column("entries").to_pylist()), ENTRY)
            block = pa.array(np.repeat(np.arange(high - low), sizes[low:high]))
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(name).take(block) for name in ("field", "bucket", "term")],
                    pa.array(entries["doc_id"], mask=entries["marks"] & NO_ID > 0),
                    pa.array(np.ascontiguousarray(entries["tf"])),
                    pa.array(np.ascontiguousarray(entries["length"])),
                    pa.array(entries["marks"] & FIRST > 0),
                ],
                ["field", "bucket", "term", "doc_id", "tf", "length", "is_first"],
            )
