"""Sorting the suffixes of blocks of text with a difference cover.

A difference cover of v is a set of residues such that for any two positions some shift
below v brings both to residues of the set.  The ranks of the suffixes at such positions
(about a fifth of all for v = 32) are worked out first.  Suffixes are then sorted by bucket
and their first v bytes, and ties are resolved by the ranks at the shift that suits both:
no comparison reads further, however long the texts agree.
"""

from __future__ import annotations

import functools

import numpy as np

COVER = 32  # v; four words of eight bytes


@functools.cache
def difference_cover(v: int = COVER) -> tuple[np.ndarray, np.ndarray]:
    """Which residues are in the cover, and shift[a, b]: the least k that brings the residues
    a and b into it.  Residues are taken greedily, by how many new differences they make."""
    chosen, differences = [0], {0}
    while len(differences) < v:
        gain = {
            r: {(r - c) % v for c in chosen} | {(c - r) % v for c in chosen} for r in range(v)
        }
        best = max(range(v), key=lambda r: (len(gain[r] - differences), -r))
        chosen.append(best)
        differences |= gain[best]
    inside = np.zeros(v, bool)
    inside[chosen] = True
    shift = np.zeros((v, v), np.int64)
    for a in range(v):
        for b in range(v):
            shift[a, b] = next(k for k in range(v) if inside[(a + k) % v] and inside[(b + k) % v])
    return inside, shift


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts like them; zeros follow the
    text."""
    filled = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | filled[k : k + len(text)]
    return out


def _word(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[np.minimum(at, len(words) - 1)] * (at < len(words)).astype(np.uint64)


def cover_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """For each place whose residue is in the cover, the rank (from 1) of the suffix there by
    its first ``depth`` bytes or more; 0 elsewhere.  Ranks by v bytes are doubled: a place
    v, 2v ... further on has the same residue."""
    n = len(words)
    inside, _ = difference_cover()
    sample = np.flatnonzero(inside[np.arange(n) % COVER])
    ranks = np.zeros(n, np.int64)
    if not len(sample):
        return ranks
    columns = [_word(words, sample + 8 * k) for k in range(COVER // 8)]
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(sample), bool)
    for column in columns:
        change[1:] |= column[order][1:] != column[order][:-1]
    ranks[sample[order]] = np.cumsum(change) + 1
    reach = COVER
    while reach < depth and change.sum() + 1 < len(sample):
        later = sample + reach
        second = np.where(later < n, ranks[np.minimum(later, n - 1)], 0)
        key = ranks[sample] * (len(sample) + 2) + second
        order = np.argsort(key, kind="stable")
        change = np.zeros(len(sample), bool)
        change[1:] = key[order][1:] != key[order][:-1]
        ranks[sample[order]] = np.cumsum(change) + 1
        reach *= 2
    return ranks


def sort_suffixes(text: np.ndarray, places: np.ndarray, buckets: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at ``places``, bucket by bucket, by ``depth`` bytes or more."""
    words = words_of(text)
    _, shift = difference_cover()
    columns = [_word(words, places + 8 * k) for k in range(COVER // 8)]
    order = np.lexsort([*columns[::-1], buckets])
    tie = _same(order, buckets)
    for column in columns:
        tie &= column[order][1:] == column[order][:-1]
    if not tie.any():
        return order
    group = np.append(0, np.cumsum(~tie))
    size = np.bincount(group)
    tied = np.flatnonzero(size[group] > 1)
    ranks = cover_ranks(words, depth)
    at, own = order[tied], group[tied]
    residue = places[at] % COVER
    low = np.full(len(size), COVER)
    high = np.full(len(size), -1)
    np.minimum.at(low, own, residue)
    np.maximum.at(high, own, residue)
    # Most ties have one residue, and one shift; others are compared two by two.
    key = ranks[np.minimum(places[at] + shift[residue, residue], len(text) - 1)]
    order[tied] = at[np.lexsort((key, own))]
    for g in np.flatnonzero((size > 1) & (low < high)):
        members = tied[own == g]

        def compare(a: int, b: int) -> int:
            k = shift[places[a] % COVER, places[b] % COVER]
            x, y = (ranks[p + k] if p + k < len(text) else 0 for p in (places[a], places[b]))
            return int(x > y) - int(x < y)

        order[members] = sorted(order[members].tolist(), key=functools.cmp_to_key(compare))
    return order


def _same(order: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return buckets[order][1:] == buckets[order][:-1]


def repeated(text: np.ndarray, places: np.ndarray, buckets: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each place are also at another one of its bucket:
    neighbours in suffix order are compared byte for byte."""
    out = np.zeros(len(places), bool)
    if len(places) < 2:
        return out
    order = sort_suffixes(text, places, buckets, length)
    words = words_of(text)
    pairs = np.flatnonzero(_same(order, buckets))
    a, b = places[order[pairs]], places[order[pairs + 1]]
    for k in range(0, length, 8):
        k = min(k, length - 8)  # the last words overlap
        same = words[a + k] == words[b + k]
        pairs, a, b = pairs[same], a[same], b[same]
    out[order[pairs]] = True
    out[order[pairs + 1]] = True
    return out
