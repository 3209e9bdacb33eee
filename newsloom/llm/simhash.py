"""SimHash near duplicates: fingerprints of word shingles, linked by Hamming distance.

Candidates come from the generalised pigeonhole principle: the bits are put into groups,
correlated ones together, and every group g gets a threshold t_g with the sum of all
t_g + 1 equal to max distance + 1.  Two fingerprints within the distance then differ in
at most t_g bits of some group g, so each is sent to the values within t_g of its own bits
in g (threshold -1: to none).  Thresholds come from dynamic programming over the estimated
numbers of candidates.  All fingerprints sent to a value are compared exactly.

Only different fingerprints are compared, so exact copies cost one row, and a value's task
returns a spanning forest of its links, never all pairs.  A value with more fingerprints
than ``BLOCK`` is dealt out as pairs of blocks, each to a group of its own.

Defined results: NULL, empty and blank texts have fingerprint zero and link like any
other; texts with fewer words than a shingle have one shingle; repeated rows are in one
component; a component of rows without id has none; an empty table has no rows; other
columns are ignored, and kept by ``deduplicate``.  Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common, components
from newsloom.llm import octets as o

BITS = 64
SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
#: Fingerprints of one value that a task compares at a time.
BLOCK = 8_192
#: Costs that the plan weighs: one row sent, one pair compared (seconds).
ROW_COST, PAIR_COST = 2e-6, 2e-9
#: Each value a fingerprint is sent to is an expression of the plan: what it costs, in rows,
#: and how many there may be for a group.  With thresholds of zero there is one.
FLIP_ROWS, MAX_FLIPS = 1_000, 1_024


# Fingerprints.


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Fingerprints of the texts of one step."""
    rows = len(offsets) - 1
    starts, ends, owner = o.runs(~o.BLANK[data], offsets)
    out = np.zeros(rows, np.uint64)
    if not len(starts):
        return out
    # The words again, lower-cased, with one space behind each.
    sizes = ends - starts + 1
    new_ends = np.cumsum(sizes)
    new_starts = new_ends - sizes
    index = np.repeat(starts - new_starts, sizes) + np.arange(new_ends[-1])
    joined = o.LOWER[data[np.minimum(index, len(data) - 1)]]
    joined[new_ends - 1] = 32
    text = joined.tobytes()

    words = np.bincount(owner, minlength=rows)
    first_word = np.cumsum(words) - words
    at = np.arange(len(starts))
    place = at - first_word[owner]
    begins = at[(place + width <= words[owner]) | ((place == 0) & (words[owner] < width))]
    lasts = np.minimum(begins + width, (first_word + words)[owner[begins]]) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(new_starts[begins].tolist(), (new_ends[lasts] - 1).tolist())
    hashes = np.array([digest(text[b:e], SEED) for b, e in spans], np.uint64)

    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    having, first, number = np.unique(owner[begins], return_index=True, return_counts=True)
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > number[:, None], axis=1, bitorder="little")
    out[having] = majority.view(np.uint64).ravel()
    return out


def fingerprint_rows(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (a signed long) of every row of ``docs``."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(batches, "text"):
            prints = fingerprints(data, offsets, width).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints)],
                ["doc_id", "text_hash", "fp"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(printed, f"doc_id {kind}, text_hash long, fp long")


# The plan: groups of bits and their thresholds.


@dataclass
class Group:
    bits: list[int]
    threshold: int

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """What to change in a value to reach every value within the threshold."""
        return [
            _signed(sum(1 << b for b in chosen))
            for t in range(self.threshold + 1)
            for chosen in combinations(self.bits, t)
        ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both, over all rows; a
    task sends at most 64 x 64 sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        sums = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "n"])

    rows = prints.select("fp").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n"))
    sums = np.zeros(BITS * BITS + 1)
    for at, n in rows.collect():
        sums[at] = n
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def correlated_groups(both: np.ndarray, n: int, number: int) -> list[list[int]]:
    """The bits in ``number`` groups: each starts with the free bit that is correlated most
    with the others and takes in those correlated most with it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    r = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    free, groups = list(range(BITS)), []
    for k in range(number):
        size = round(len(free) / (number - k))
        first = free[int(np.argmax(r[np.ix_(free, free)].sum(axis=1)))]
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = free[int(np.argmax(r[np.ix_(free, group)].sum(axis=1)))]
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def plan(both: np.ndarray, n: int, distance: int = MAX_DISTANCE) -> list[Group]:
    """Groups and thresholds of the least estimated cost, over several numbers of groups."""
    share = np.diag(both) / max(n, 1)
    differ = 2 * share * (1 - share)
    best_cost, best = np.inf, []
    for number in range(2, distance + 3):
        groups = correlated_groups(both, n, number)
        costs = [_costs(differ[g], n, distance) for g in groups]
        # table[s]: least cost of the groups so far whose t_g + 1 add up to s.
        table = [(0.0, ())] + [(np.inf, ())] * (distance + 1)
        for cost in costs:
            table = [
                min((table[s - u][0] + cost[u], (*table[s - u][1], u)) for u in range(s + 1))
                for s in range(distance + 2)
            ]
        cost, used = table[distance + 1]
        if cost < best_cost:
            best_cost = cost
            best = [Group(g, u - 1) for g, u in zip(groups, used) if u > 0]
    return best


def _costs(differ: np.ndarray, n: int, distance: int) -> list[float]:
    """Estimated cost of the thresholds -1, 0, 1 ... in one group: rows sent, and pairs
    compared if its bits differ independently with the given probabilities."""
    chance = np.zeros(distance + 2)
    chance[0] = 1.0
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    out, ball, ways = [0.0], 0, 1
    for t in range(distance + 1):
        ball += ways
        ways = ways * (len(differ) - t) // (t + 1)
        pairs = n * n / 2 * chance[: t + 1].sum() * ball
        cost = (n + FLIP_ROWS) * ball * ROW_COST + pairs * PAIR_COST
        out.append(cost if ball <= MAX_FLIPS else np.inf)
    return out


# Links.


def spanning_forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what links of at most ``distance`` join, one less than nodes at most.

    A search from node to node, in which a block of nodes meets all not yet reached."""
    none = np.zeros(0, prints.dtype)
    if len(prints) < 2:
        return none, none
    if len(prints) <= 256:
        apart = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
        if apart.sum() == len(prints):
            return none, none
    froms, tos = [], []
    front, rest = prints[:1], prints[1:]
    while len(rest):
        if not len(front):
            front, rest = rest[:1], rest[1:]
            continue
        block = front[: max(1, (1 << 20) // len(rest))]
        front = front[len(block) :]
        close = np.bitwise_count(block[:, None] ^ rest[None, :]) <= distance
        hit = close.any(axis=0)
        if hit.any():
            reached = rest[hit]
            froms.append(block[close[:, hit].argmax(axis=0)])
            tos.append(reached)
            front, rest = np.concatenate([front, reached]), rest[~hit]
    if not froms:
        return none, none
    return np.concatenate(froms), np.concatenate(tos)


def _dealt(prints: DataFrame, groups: list[Group]) -> DataFrame:
    """(g, value, i, j, fp): each fingerprint at every value it is sent to.  i and j are
    zero, but for values with more than BLOCK rows, which are pairs of blocks."""

    def sent(k: int, group: Group) -> list[Column]:
        value = F.col("fp").bitwiseAND(F.lit(group.mask))
        return [
            F.struct(F.lit(k).alias("g"), value.bitwiseXOR(F.lit(flip)).alias("value"))
            for flip in group.flips()
        ]

    targets = [column for k, group in enumerate(groups) for column in sent(k, group)]
    rows = prints.select("fp", F.explode(F.array(*targets)).alias("to")).select(
        F.col("to.g").alias("g"), F.col("to.value").alias("value"), "fp"
    )
    crowded = common.stored(
        rows.groupBy("g", "value").count().where(F.col("count") > BLOCK), "crowded-values"
    )
    one = rows.withColumns({"i": F.lit(0), "j": F.lit(0)}).select("g", "value", "i", "j", "fp")
    if crowded.isEmpty():
        return one
    keys = ["g", "value"]
    blocks = F.ceil(F.col("count") / (BLOCK // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    split = (
        rows.join(crowded.withColumn("blocks", blocks), keys)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    )
    return one.join(crowded, keys, "left_anti").unionByName(split.select(*one.columns))


def links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, distinct) that join every
    two within the distance, directly or over others."""
    n, both = bit_counts(prints)
    dealt = _dealt(prints, plan(both, n, distance))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key_runs in _runs(batches):
            froms, tos = zip(*(spanning_forest(run, distance) for run in key_runs))
            a, b = np.concatenate(froms), np.concatenate(tos)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
                )

    keys = ["g", "value", "i", "j"]
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)
    return together.mapInArrow(linked, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Fingerprints of each key, from rows sorted by key; keys of one row are left out."""
    held = np.zeros((0, 5), np.int64)
    for batch in batches:
        rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
        rows = np.concatenate([held, rows])
        change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        last = change[-1] if len(change) else 0
        if last:
            yield from _cut(rows[:last], change[:-1])
        held = rows[last:]
    if len(held):
        yield from _cut(held, np.zeros(0, np.int64))


def _cut(rows: np.ndarray, change: np.ndarray) -> Iterator[list[np.ndarray]]:
    starts, ends = np.append(0, change), np.append(change, len(rows))
    many = np.flatnonzero(ends - starts > 1)
    prints = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
    if len(many):
        yield [prints[starts[k] : ends[k]] for k in many]


# Components.


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component, first_hash): the smallest row of each component, for each fingerprint."""
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    different = common.stored(prints.groupBy("fp").agg(smallest.alias("first")), "fingerprints")
    roots = components.components(links(different.select("fp"), distance))
    named = different.join(roots, different["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    # Written, so that the join reads plain shuffles and a large component is split.
    named = common.stored(named, "named")
    first = common.stored(named.groupBy("root").agg(F.min("first").alias("first")), "firsts")
    return named.select("fp", "root").join(first, "root").select("fp", "first")


def components_of(
    docs: DataFrame, width: int = SHINGLE, distance: int = MAX_DISTANCE
) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``."""
    prints = common.stored(fingerprint_rows(docs, width), "prints")
    return prints.join(_classes(prints, distance), "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def deduplicate(docs: DataFrame, width: int = SHINGLE, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each component: that with the smallest id (rows without id last), of
    repeated ids that with the smallest hash of its text.  Columns are kept."""
    prints = common.stored(fingerprint_rows(docs, width), "prints")
    # One kind of key for both steps, so that the texts are shuffled once.
    stay = _classes(prints, distance).select(
        F.xxhash64("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")
    )
    rows = docs.select(
        F.struct("*").alias("row"), F.xxhash64("doc_id").alias("id"), F.xxhash64("text").alias("hash")
    )
    found = rows.join(stay.distinct(), ["id", "hash"], "left_semi")
    return found.dropDuplicates(["id", "hash"]).select("row.*")
