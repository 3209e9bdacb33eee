"""Content-defined buckets of substrings: equal strings of a given length fall into one.

Every window of ``length`` bytes is owned by the smallest of the hashes of its ``GRAM``-byte
grams, the leftmost of equal ones.  Equal windows have equal owners at equal offsets, so
they meet if windows are put into buckets by owner and offset.  Windows with one owner and
neighbouring offsets are kept together, as blocks of at most ``group`` offsets: all windows
of a block contain its core, and the block's context contains all its windows.
"""

from __future__ import annotations

import numpy as np

from newsloom.llm import octets as o

GRAM = 32
_PLACE = np.uint64((1 << 24) - 1)  # bits of a key that hold the place in a step


def owners(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside the rows, and the place of each one's owner."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none
    at = np.arange(n - GRAM + 1)
    keys = o.span_hashes(data, at, at + GRAM) & ~_PLACE | at.astype(np.uint64)
    least = sliding_minimum(keys, length - GRAM + 1)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    inside = np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return inside, (least[inside] & _PLACE).astype(np.int64)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from minima inside blocks."""
    n = len(values)
    full = -(-n // width) * width
    filled = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    filled[:n] = values
    table = filled.reshape(-1, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def blocks(
    data: np.ndarray, offsets: np.ndarray, length: int, group: int
) -> tuple[np.ndarray, ...]:
    """(row, first, last, core, context): windows with one owner and offsets of one group
    start from ``first`` to ``last``; hashes of core and context, with their offsets."""
    starts, owner = owners(data, offsets, length)
    return block_runs(data, starts, owner, o.rows_of(starts, offsets), length, group)


def block_runs(data, starts, owner, row, length, group) -> tuple[np.ndarray, ...]:
    part = (owner - starts) // group
    new = np.ones(len(starts), bool)
    new[1:] = (
        (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        | (starts[1:] != starts[:-1] + 1)
    )
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts))[: len(heads)] - 1
    first, last = starts[heads], starts[tails]
    anchor, b = owner[heads], part[heads]
    core_from, core_to = anchor - b * group, anchor - b * group - group + 1 + length
    core = o.mix(o.span_hashes(data, core_from, core_to) + b.astype(np.uint64))
    shift = (anchor - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
    context = o.mix(o.span_hashes(data, first, last + length) + o.mix(shift))
    return row[heads], first, last, anchor, core, context
