"""Spelling variants: a dictionary of pairs of trie nodes.

The words are put into two tries, one from the left and one from the right, and every node
has a number.  Leaving out the letter at place i leaves the pair (node of the i letters
before, node of the letters behind); the gap before place i is the pair of the letters on
both sides.  Two words that meet in a pair, both with a letter left out, differ in that
letter; a word with a letter left out meets the one without that letter in its gap.  So the
pairs give all words at a distance of one inserted, deleted or replaced letter, and no
others: nothing has to be compared afterwards.  A letter that could be deleted at several
places of a row of equal letters counts at the first.

The tries are numbered in parallel: the words are dealt into ranges of their order, a range
walks its sorted words, and a node is new where a word leaves the one before it.  A prefix
that reaches into several ranges is a prefix of a bound between them; the bounds are known
to all, and number these nodes.

A pair holds at most one word with its gap and one word for each letter, so that a group is
bounded by the alphabet, and yields only the number of its words and the strongest two,
never the pairs of its words.  A word is as many rows as it has letters, times two, whatever
its length.

Words are counted in the tasks before they are shuffled.  A NULL or empty text has no words,
a document without an id is read as it stands, repeated rows count each time, an empty table
gives an empty one, further columns are not read.  Words of equal strength are in
code-point order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import hashed_limit, stored

#: Least code points and occurrences of a word, least ratio of a form's occurrences.
MIN_LETTERS, MIN_COUNT, RATIO = 7, 2, 10
#: Words of a range, and ranges at most; a bound between them is cut to so many letters.
RANGE_WORDS, MOST_RANGES, BOUND_LETTERS = 100_000, 4096, 32
#: Bits of the number of a word or a node within its range.
RANGE_BITS = 40
#: Rows that one numpy step works on.
STEP_ROWS = 1 << 18

# --- fixed values: letters, and the case that is folded --------------------------
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ---------------------------------------------------------------------------------


def word_counts(
    docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, text: str = "text"
) -> DataFrame:
    """(word, n) of the lower-cased runs of letters."""
    return _counted(_runs(docs, text, min_letters).select(F.col("run").alias("word")), min_letters, min_count)


def _runs(docs: DataFrame, text: str, min_letters: int) -> DataFrame:
    """(doc_id, run): every run of at least ``min_letters``, lower-cased."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_letters},}}"), F.lit(0))
    runs = docs.select("doc_id", F.explode(found).alias("run"))
    return runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def _counted(words: DataFrame, min_letters: int, min_count: int) -> DataFrame:
    long = words.where(F.char_length("word") >= min_letters)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# The tries.


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # the first difference is in [low, high]
    while low < high:
        middle = (low + high) // 2
        if a[low : middle + 1] == b[low : middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low


def range_bounds(words: DataFrame, word: Column) -> list[str]:
    """Bounds of ranges of about equally many words, from a sample by hash; there are at
    most ``MOST_RANGES`` - 1, of ``BOUND_LETTERS`` letters."""
    ranges = min(-(-words.count() // RANGE_WORDS), MOST_RANGES)
    if ranges <= 1:
        return []
    sample = hashed_limit(words.select("word"), "word", 16 * ranges)
    heads = sorted(r[0] for r in sample.select(F.substring(word, 1, BOUND_LETTERS)).collect())
    return sorted({heads[k * len(heads) // ranges] for k in range(1, ranges)})


def in_ranges(rows: DataFrame, word: Column, bounds: list[str]) -> DataFrame:
    """``rows`` with ``range``, sorted by it and by ``trie_word``, equal ranges together."""
    # Nested tests, so that a word is compared with a few of the bounds.
    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(word < F.lit(bounds[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    if len(bounds) <= 64:
        ranged = rows.withColumn("range", place(0, len(bounds)))
    else:
        sides = F.array(*[F.lit(b) for b in bounds])
        ranged = rows.withColumn("range", F.size(F.filter(sides, lambda b: b <= word)))
    ranged = ranged.withColumn("trie_word", word)
    return ranged.repartition("range").sortWithinPartitions("range", "trie_word")


class TrieNumbers:
    """Numbers of the nodes on the ways of sorted words, range by range.

    The root is 0, a prefix of a bound has a negative number that all ranges know, and any
    other node one of its range's own."""

    def __init__(self, bounds: list[str]):
        self._bounds = bounds
        self._shared: list[list[int]] = []
        for k, bound in enumerate(bounds):
            old = self._shared[k - 1][: common_prefix(bounds[k - 1], bound) + 1] if k else [0]
            top = self._shared[k - 1][-1] if k else 0
            lowest = min(self._lowest, top) if k else 0
            new = range(lowest - 1, lowest - 1 - (len(bound) + 1 - len(old)), -1)
            self._shared.append([*old, *new])
            self._lowest = min([lowest, *new])
        self._range, self._word, self._way, self._next = None, "", [0], 0

    def way(self, place: int, word: str) -> list[int]:
        """Numbers of the prefixes of ``word``, the empty one first; ``place`` is its range."""
        if place != self._range:
            self._range, self._word, self._way = place, "", [0]
            self._next = ((place + 1) << RANGE_BITS) + 1
        way = self._way[: common_prefix(self._word, word) + 1]
        if len(way) <= len(word):
            for k in (place - 1, place):
                if 0 <= k < len(self._bounds):
                    known = common_prefix(self._bounds[k], word)
                    if known >= len(way):
                        way += self._shared[k][len(way) : known + 1]
            new = len(word) + 1 - len(way)
            way += range(self._next, self._next + new)
            self._next += new
        self._word, self._way = word, way
        return way


def with_prefix_nodes(words: DataFrame, bounds: list[str]) -> DataFrame:
    """(id, word, n, nodes): the words numbered in code-point order, with the nodes of their
    prefixes in the trie from the left."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, before, row = TrieNumbers(bounds), None, 0
        for batch in batches:
            ids, nodes = [], []
            texts, places = batch.column("word").to_pylist(), batch.column("range").to_pylist()
            for place, word in zip(places, texts):
                before, row = place, row + 1 if place == before else 0
                ids.append((place << RANGE_BITS) + row)
                nodes.append(trie.way(place, word))
            columns = [pa.array(ids, pa.int64()), batch.column("word"), batch.column("n")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(nodes, pa.list_(pa.int64()))], ["id", "word", "n", "nodes"]
            )

    ranged = in_ranges(words, F.col("word"), bounds).select("range", "word", "n")
    return ranged.mapInArrow(walked, "id long, word string, n long, nodes array<long>")


#: What a word is in a pair: its gap, or itself with a letter left out, at the first place
#: of a row of equal letters or at a later one.
GAP, LATER, FIRST = 0, 1, 2


def node_pairs(words: DataFrame, bounds: list[str]) -> DataFrame:
    """(p, s, n, code) for every place of every word: the pair of nodes; ``code`` is four
    times the word's id, and what the word is in the pair."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieNumbers(bounds)
        for batch in batches:
            p, s, n, code = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("range", "trie_word", "id", "n", "nodes")]
            for place, backwards, own, times, prefixes in zip(*columns):
                letters = len(backwards)
                suffixes = trie.way(place, backwards)[::-1]  # those of 0, 1, 2, ... letters less
                word = backwards[::-1]
                p += prefixes
                s += suffixes
                p += prefixes[:-1]
                s += suffixes[1:]
                n += [times] * (2 * letters + 1)
                code += [own * 4 + GAP] * (letters + 1)
                first, later = own * 4 + FIRST, own * 4 + LATER
                code.append(first)
                code += [later if a == b else first for a, b in zip(word, word[1:])]
                if len(p) >= STEP_ROWS:
                    yield _longs(p=p, s=s, n=n, code=code)
                    p, s, n, code = [], [], [], []
            if p:
                yield _longs(p=p, s=s, n=n, code=code)

    ranged = in_ranges(words.select("id", "n", "nodes", "word"), F.reverse("word"), bounds)
    return ranged.drop("word").mapInArrow(paired, "p long, s long, n long, code long")


def _longs(**columns) -> pa.RecordBatch:
    arrays = [pa.array(np.asarray(c, np.int64)) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _starts_of(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group


def _meetings(group: np.ndarray, n: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the words of each group gain; rows are sorted by group, the strongest first."""
    kind, own = code & 3, code >> 2

    def out(rows, near, best):
        return _longs(id=own[rows], n=n[rows], near=near, best=own[best], best_n=n[best])

    skipped = np.flatnonzero(kind != GAP)
    if len(skipped):  # words that differ in the letter left out
        starts = _starts_of(group[skipped])
        sizes = np.diff(np.append(starts, len(skipped)))
        several = np.repeat(sizes > 1, sizes)
        rows = skipped[several]
        top = np.repeat(skipped[starts[sizes > 1]], sizes[sizes > 1])
        second = np.repeat(skipped[starts[sizes > 1] + 1], sizes[sizes > 1])
        yield out(rows, np.repeat(sizes[sizes > 1] - 1, sizes[sizes > 1]), np.where(rows == top, second, top))
    gaps, firsts = np.flatnonzero(kind == GAP), np.flatnonzero(kind == FIRST)
    if len(gaps) and len(firsts):  # words with one letter more, and those without it
        starts = _starts_of(group[firsts])
        sizes = np.diff(np.append(starts, len(firsts)))
        at = np.searchsorted(group[firsts[starts]], group[gaps])
        at_most = np.minimum(at, len(starts) - 1)
        met = group[firsts[starts[at_most]]] == group[gaps]
        gaps, at = gaps[met], at[met]
        yield out(gaps, sizes[at], firsts[starts[at]])
        shorter = np.full(len(starts), -1)
        shorter[at] = gaps
        shorter = np.repeat(shorter, sizes)
        rows = firsts[shorter >= 0]
        yield out(rows, np.ones(len(rows), np.int64), shorter[shorter >= 0])


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n, n_near, best, best_n): words that have near words, how many, and the
    strongest of them."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in _and_none(batches):
            if batch is not None:
                held = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns)]
                if len(held[0]) < STEP_ROWS:
                    continue
            p, s, n, code = held
            if not len(p):
                return
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
            # The last group may go on in the next batch.
            end = len(p) if batch is None else int(np.flatnonzero(new)[-1])
            held = [column[end:] for column in held]
            group = np.cumsum(new[:end])
            sizes = np.bincount(group) if end else np.zeros(1, np.int64)
            several = sizes[group] > 1
            yield from _meetings(group[several], n[:end][several], code[:end][several])

    together = pairs.repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "code")
    gains = together.mapInArrow(met, "id long, n long, near long, best long, best_n long")
    strongest = F.max(F.struct("best_n", (-F.col("best")).alias("minus")))
    sums = gains.groupBy("id").agg(
        F.first("n").alias("n"), F.sum("near").alias("n_near"), strongest.alias("strongest")
    )
    best = (-F.col("strongest.minus")).alias("best")
    return sums.select("id", "n", "n_near", best, F.col("strongest.best_n").alias("best_n"))


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): the end of the way from form to form.

    Each step doubles the ways; as a form is more frequent than its word by a factor, there
    are few."""
    ways = stored(forms.select("id", F.col("form").alias("root")), "forms")
    while True:
        further = ways.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = ways.join(further, "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = stored(moved, "forms")
        ways = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            return ways


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """From (word, n), each word once: word, form, root, n, n_near, form_n.

    ``n_near`` counts the words at one inserted, deleted or replaced code point; ``form`` is
    the most frequent of them (of equals the first in code-point order) if it is at least
    ``ratio`` times as frequent, ``root`` the last of the forms' forms."""
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = stored(words.select("word", "n"), "words")
    known = stored(with_prefix_nodes(words, range_bounds(words, F.col("word"))), "prefixes")
    pairs = node_pairs(known, range_bounds(words, F.reverse("word")))
    near = stored(near_words(pairs), "near")
    formed = near.where(F.col("best_n") >= ratio * F.col("n"))
    roots = last_forms(formed.select("id", F.col("best").alias("form")))
    spelled = known.select("id", "word")
    named = (
        formed.select("id", "best", "best_n")
        .join(roots, "id")
        .join(spelled.select(F.col("id").alias("best"), F.col("word").alias("form")), "best")
        .join(spelled.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
        .select("id", "form", "root_word", F.col("best_n").alias("form_n"))
    )
    return (
        known.select("id", "word", "n")
        .join(near.select("id", "n_near"), "id", "left")
        .join(named, "id", "left")
        .select(
            "word",
            "form",
            F.coalesce("root_word", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )


# The registered query.


def misspelled_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word_counts`` after the contract's deletions: of one in 31 runs, by document and
    run, a letter is left out."""
    runs = _runs(docs, "text", min_letters)
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run").cast("binary"))
    hashed = runs.select("run", F.when(F.col("doc_id").isNotNull(), h).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run"))
    return _counted(hashed.select(word.alias("word")), min_letters, min_count)


def grouped(docs: DataFrame) -> DataFrame:
    return variants(misspelled_counts(docs))
