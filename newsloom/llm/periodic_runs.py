"""Periodic runs of words: maximal pairs of an LCP-interval tree.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and
a length of at least max(``min_length``, ``exponent`` * q) that no neighbouring word extends.
Such a stretch is a maximal pair: the two equal word sequences that start q apart, with
different words before and behind them.  So the tree of common prefixes of all suffixes is
walked bottom-up, every node holding its suffixes by the word to their left, and of two
children's suffixes only those are paired that differ there and whose distance fits the
length of the node's prefix.  Nothing is extended afterwards; of the pairs of one stretch,
the smallest distance is its period.

Suffixes of many texts are sorted at once by prefix doubling in numpy.  The tree is kept to
suffixes that share enough words with another one, and to groups in which two of them are
near enough.  Near occurrences of one sequence lie in arithmetic progressions, all but the
first with the same word to the left; this is why one look at either side of a suffix finds
its partners, and the work follows the number of runs.

A NULL or empty text has no words and no runs.  Very long texts are a step of their own;
nothing is cut.  Repeated rows and ids each get their result, rows without an id are never
rewritten, an empty table gives an empty one, and further columns, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import text_steps

#: Least number of words of a run, and of periods in it.
MIN_LENGTH, EXPONENT = 6, 4


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal only for equal words of one text, with a number of its own
    behind each text; and where the texts begin."""
    numbers: list[int] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for k, words in enumerate(texts):
        first: dict[bytes, int] = {}
        numbers.extend(map(first.setdefault, words, count(len(numbers))))
        numbers.append(len(numbers))
        starts[k + 1] = len(numbers)
    return np.array(numbers, np.int64), starts


def _group_starts(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the index at which each one's group begins."""
    at = np.arange(len(keys))
    at[1:][keys[1:] == keys[:-1]] = 0
    return np.maximum.accumulate(at)


def _repeated(begin: np.ndarray) -> np.ndarray:
    """Whether a group, given by its members' common start, has several members."""
    same = begin[1:] == begin[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def sorted_suffixes(numbers: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that have at least ``shared`` words (a power of two) in common with
    another one, sorted, and with how many of them each one begins like the one before.

    Ranks by 1, 2, 4, ... words are kept; a common prefix is put together from the largest
    power of two downwards."""
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    begin = _group_starts(numbers[order])
    rank = np.empty(n, np.int32)
    rank[order] = begin
    ranks, width, wanted = [rank], 1, order[:0]
    active = order[_repeated(begin)]
    while len(active):
        if width == shared:
            wanted = active
        own, behind = rank[active].astype(np.int64), rank[active + width]
        by = np.argsort(own * n + behind, kind="stable")
        active, own, key = active[by], own[by], (own * n + behind)[by]
        begin = _group_starts(key)
        rank = rank.copy()
        rank[active] = own + begin - _group_starts(own)
        ranks.append(rank)
        active = active[_repeated(begin)]
        width *= 2
    wanted = wanted[np.argsort(rank[wanted])]
    common = np.zeros(len(wanted), np.int64)
    a, b = wanted[:-1].copy(), wanted[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][a] == ranks[k][b]
        a[same] += 1 << k
        b[same] += 1 << k
    common[1:] = a - wanted[:-1]
    return wanted, common


class _Suffixes:
    """The suffixes of a node: in order of place, and in lists by the word to the left."""

    __slots__ = ("classes", "places")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left: [place]}


def maximal_pairs(
    suffixes: list[int], common: list[int], left: np.ndarray, least: int, shortest: int, exponent: int
) -> Iterator[tuple[int, int, int]]:
    """(place, distance, common words) of the maximal pairs that are runs' stretches: at
    most a (``exponent`` - 1)th of the common words apart, and ``shortest`` words in all.

    ``common`` is below ``least`` where a group begins; such nodes have no pairs."""
    before = dict(zip(suffixes, left[suffixes].tolist()))
    pairs: list[tuple[int, int, int]] = []

    def joined(one: _Suffixes, other: _Suffixes, depth: int) -> _Suffixes:
        """All suffixes of two children of a node; their pairs are noted."""
        if len(one.places) < len(other.places):
            one, other = other, one
        places, classes = one.places, one.classes
        far, near = depth // (exponent - 1), max(1, shortest - depth)
        for i in other.places:
            word = before[i]
            k = bisect_right(places, i)
            if k < len(places) and places[k] - i <= far and before[places[k]] != word:
                fitting = classes[before[places[k]]]
                for j in fitting[bisect_right(fitting, i) : bisect_right(fitting, i + far)]:
                    if j - i >= near:
                        pairs.append((i, j - i, depth))
            j = places[k - 1] if k else i
            if k and i - j <= far:
                j = places[bisect_left(places, i - far)]
                if before[j] != word and i - j >= near:
                    pairs.append((j, i - j, depth))
        for i in other.places:
            insort(places, i)
            insort(classes.setdefault(before[i], []), i)
        return one

    stack: list[tuple[int, _Suffixes]] = []
    last = None
    for place, depth in zip([*suffixes, -1], [*common, 0]):
        while stack and stack[-1][0] > depth:
            above, node = stack.pop()
            last = joined(node, last, above)
        if depth >= least:
            if stack and stack[-1][0] == depth:
                last = joined(stack.pop()[1], last, depth)
            stack.append((depth, last))
        yield from pairs
        pairs.clear()
        if place >= 0:
            last = _Suffixes(place, before[place])


def runs_of(
    numbers: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT
) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of numbers, by start and period.

    ``exponent``, at least 3, is the least number of periods in a run.  Texts put end to
    end must be separated by numbers that occur once."""
    if exponent < 3 or min_length < 2:
        raise ValueError("runs have at least three periods and two words")
    if len(numbers) < min_length:
        return []
    least = min(max(min_length - q, (exponent - 1) * q) for q in range(1, min_length + 1))
    suffixes, common = sorted_suffixes(numbers, 1 << (least.bit_length() - 1))
    if not len(suffixes):
        return []
    # Only groups in which two suffixes are near enough for the longest common prefix.
    group = np.cumsum(common < least)
    by = np.lexsort((suffixes, group))
    gap = np.diff(suffixes[by])
    inside = np.diff(group[by]) == 0
    nearest = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(nearest, group[by][1:][inside], gap[inside])
    longest = np.zeros(group[-1] + 1, np.int64)
    np.maximum.at(longest, group, np.where(common >= least, common, 0))
    kept = (nearest <= longest // (exponent - 1))[group]
    suffixes, common = suffixes[kept], common[kept]
    left = np.concatenate([[-1], numbers[:-1]])
    periods: dict[tuple[int, int], int] = {}
    for place, distance, depth in maximal_pairs(
        suffixes.tolist(), common.tolist(), left, least, min_length, exponent
    ):
        stretch = (place, depth + distance)
        periods[stretch] = min(periods.get(stretch, distance), distance)
    return sorted(((s, n, q) for (s, n), q in periods.items()), key=lambda run: (run[0], run[2]))


def runs_of_texts(
    texts: list[list[bytes]], min_length: int = MIN_LENGTH, exponent: int = EXPONENT
) -> list[list[tuple[int, int, int]]]:
    """``runs_of`` for each of several texts, given as words."""
    numbers, starts = numbered(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = runs_of(numbers, min_length, exponent)
    rows = np.searchsorted(starts, [run[0] for run in runs], "right") - 1
    for row, (start, length, period) in zip(rows.tolist(), runs):
        found[row].append((start - int(starts[row]), length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without those of a run behind its first period."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        kept = np.cumsum(depth[:-1]) == 0
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def _words_of(data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    ends = offsets.tolist()
    return [data[a:b].tobytes().split() for a, b in zip(ends, ends[1:])]


def find_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, text: str = "text"
) -> DataFrame:
    """doc_id and ``runs``, an array of (start, length, period) in words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch, data, offsets in text_steps(batches, "text"):
            runs = runs_of_texts(_words_of(data, offsets), min_length, exponent)
            rows = [[dict(zip(("start", "length", "period"), run)) for run in row] for row in runs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "runs"])

    rows = docs.select("doc_id", F.col(text).alias("text"))
    run = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return rows.mapInArrow(found, f"doc_id {dict(rows.dtypes)['doc_id']}, runs {run}")


def collapse(
    docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, text: str = "text"
) -> DataFrame:
    """doc_id and ``collapsed``: the words of the text with every run cut to one period."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_steps(batches, "text"):
            texts = _words_of(data, offsets)
            runs = runs_of_texts(texts, min_length, exponent)
            kept = [collapsed(*row).decode() for row in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string())], ["doc_id", "collapsed"])

    rows = docs.select("doc_id", F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {dict(rows.dtypes)['doc_id']}, collapsed string")


# The registered query.

_COUNTS = ("start", "length", "period", "exponent_milli")


def made_periodic(words: list[bytes], h: int | None) -> list[bytes]:
    """The words of the contract: a tenth of the documents repeats a stretch to its end."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    first, period = g % n, 1 + (n - g % n) // (3 + g % 8)
    tail = words[first : first + period] * ((n - first) // period + 1)
    return words[:first] + tail[: n - first]


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period; of equals the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: number of runs, the greatest one, and digests of the runs and of
    the collapsed text, after the rewriting that the contract fixes."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_steps(batches, "text"):
            texts = _words_of(data, offsets)
            texts = [made_periodic(w, h) for w, h in zip(texts, batch.column("h").to_pylist())]
            found = runs_of_texts(texts)
            best = [greatest(runs) for runs in found]
            counts = {
                "start": [b and b[0] for b in best],
                "length": [b and b[1] for b in best],
                "period": [b and b[2] for b in best],
                "exponent_milli": [b and 1000 * b[1] // b[2] for b in best],
            }
            lists = ["".join(f"{s},{n},{q}\n" for s, n, q in runs) for runs in found]
            kept = [hashlib.sha256(collapsed(*row)).hexdigest() for row in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(runs) for runs in found], pa.int64()),
                    *[pa.array(counts[c], pa.int64()) for c in _COUNTS],
                    pa.array([hashlib.sha256(text.encode()).hexdigest() for text in lists]),
                    pa.array(kept, pa.string()),
                ],
                ["doc_id", "n_runs", *_COUNTS, "runs_sha256", "collapsed_sha256"],
            )

    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", key.alias("h"), "text")
    longs = ", ".join(f"{c} bigint" for c in ("n_runs", *_COUNTS))
    digest = "runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(judged, f"doc_id {dict(rows.dtypes)['doc_id']}, {longs}, {digest}")
