"""Language-model scores: a log-bilinear neural model fitted by noise-contrastive estimation.

Token counts come from all training documents, in one shuffle.  The model predicts a
token's class from the two classes before it: frequent tokens and the end are classes of
their own, other tokens share classes by their last two bytes.  The predicted vector is a
sum of linear maps of the context's vectors, its products with the classes' vectors are
their scores.  Inside a shared class, tokens have their smoothed relative frequencies, so
a token's probability is normalised over all training tokens and one unseen one.

The gradient steps use all positions of all training documents: each class with its context
is counted, and the counts, which weigh the steps, are dealt to learners.  The more
different ones there are, the more learners; their parameters are averaged after each
epoch.  A learner has at most about twice ``LEARNER_ROWS`` rows.  Scoring takes batched
matrix products over the different contexts of a step, whose normalising constants are kept.  Counts of the ``FREQUENT`` most frequent tokens at most go
to every task; the others, of which there may be any number, are joined.

Tokens are 64-bit hashes of words; texts are taken whole, a step of text at a time.

Defined results: a NULL or empty text is just its end; rows without id are training rows;
repeated rows count each and get equal scores; without training tokens the base score is
0 and the model knows only the end; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm import octets as o

CLASSES = 1024
SHARED = 256  # the last ones
DIMENSION = 32
CONTEXT = 2
FREQUENT = 500_000
#: Different classes with context of a learner; their counts are split into as many rows more.
LEARNER_ROWS = 500_000
NOISE = 64
EPOCHS = 3
#: Different tokens, or classes with context, a task holds before it sends their counts.
HELD = 200_000
#: Contexts whose constants are worked out in one product.
CONSTANT_ROWS = 2048

END = np.uint64(0x5851F42D4C957F2D)
_LN10 = float(np.log(10))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shared classes of all tokens, each text's words and its end, and the n + 1
    offsets."""
    lower = o.LOWER[data]
    starts, ends, owner = o.runs(~o.BLANK[data], offsets)
    words = o.span_hashes(lower, starts, ends)
    tail = o.span_hashes(lower, np.maximum(ends - 2, starts), ends)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    bounds = np.append(0, np.cumsum(counts + 1))
    hashes = np.full(bounds[-1], END, np.uint64)
    shared = np.zeros(bounds[-1], np.int16)
    at = np.arange(len(words)) + owner
    hashes[at] = words
    shared[at] = (tail % np.uint64(SHARED)).astype(np.int16)
    return hashes, shared, bounds


# Counts.


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, shared, n) over all texts of ``docs``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for _, data, offsets in common.text_steps(batches, "text"):
            hashes, shared, _ = tokens(data, offsets)
            token, first, n = np.unique(hashes, return_index=True, return_counts=True)
            held.append((token, shared[first], n))
            size += len(token)
            if size > HELD:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield _counts_batch(held.pop())
                    size = 0
        if held:
            yield _counts_batch(_merged(held))

    rows = docs.select("text").mapInArrow(counted, "token long, shared short, n long")
    return rows.groupBy("token").agg(F.max("shared").alias("shared"), F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    token, shared, n = (np.concatenate(column) for column in zip(*parts))
    token, first, inverse = np.unique(token, return_index=True, return_inverse=True)
    return token, shared[first], np.bincount(inverse, n).astype(np.int64)


def _counts_batch(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    token, shared, n = part
    return pa.RecordBatch.from_arrays(
        [pa.array(token.view(np.int64)), pa.array(shared), pa.array(n.astype(np.int64))],
        ["token", "shared", "n"],
    )


# The model.


@dataclass
class Vocabulary:
    """Frequent tokens, sorted, with their counts and classes, and totals of all."""

    token: np.ndarray
    count: np.ndarray
    kind: np.ndarray  # class of each, shared or its own
    least: int  # tokens with as many occurrences are all in it
    total: int
    distinct: int
    class_total: np.ndarray  # occurrences and different tokens of each class
    class_distinct: np.ndarray

    def look_up(self, hashes: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of tokens, and their counts (-1: not among the frequent)."""
        kinds = (CLASSES - SHARED + shared).astype(np.int64)
        counts = np.full(len(hashes), -1, np.int64)
        if len(self.token):
            at = np.minimum(np.searchsorted(self.token, hashes), len(self.token) - 1)
            known = self.token[at] == hashes
            kinds[known] = self.kind[at[known]]
            counts[known] = self.count[at[known]]
        kinds[hashes == END] = 0
        return kinds, counts


@dataclass
class Model:
    vocabulary: Vocabulary
    vectors: np.ndarray  # (CLASSES + 1, DIMENSION); the last: before the text
    maps: list[np.ndarray]  # one (DIMENSION, DIMENSION) for each place of the context
    targets: np.ndarray  # (CLASSES, DIMENSION)
    bias: np.ndarray
    name: str = field(default="")

    def __post_init__(self) -> None:
        parts = [self.vectors, *self.maps, self.targets, self.bias]
        self.name = hashlib.sha256(b"".join(p.tobytes() for p in parts)).hexdigest()


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """Collects at most ``frequent`` rows and the end: all tokens that occur often enough, by a limit that
    so many at most reach.  The limit comes from counts of counts, some hundred rows."""
    level = F.floor(8 * F.log2("n")).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).collect()
    room, least_level = frequent, None
    for row in sorted(levels, key=lambda r: -r.level):
        room -= row.tokens
        if room < 0:
            break
        least_level = row.level
    least = int(np.ceil(2 ** (least_level / 8) - 1e-9)) if least_level is not None else 1 << 62
    # The end has a class of its own, however rare it is.
    is_end = F.col("token") == int(END.view(np.int64))
    often = F.lit(False) if least_level is None else level >= least_level
    found = counts.where(often | is_end).select("token", "shared", "n").toArrow()
    token = np.asarray(found.column("token"), np.int64).view(np.uint64)
    shared = np.asarray(found.column("shared"), np.int64)
    n = np.asarray(found.column("n"), np.int64)
    order = np.argsort(token)
    token, shared, n = token[order], shared[order], n[order]
    kind = CLASSES - SHARED + shared
    kind[token == END] = 0
    words = np.flatnonzero(token != END)
    own = words[np.lexsort((token[words], -n[words]))][: CLASSES - SHARED - 1]
    kind[own] = 1 + np.arange(len(own))

    sums = counts.groupBy("shared").agg(F.sum("n").alias("n"), F.count("*").alias("tokens")).collect()
    class_total, class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in sums:
        class_total[CLASSES - SHARED + row.shared] = row.n
        class_distinct[CLASSES - SHARED + row.shared] = row.tokens
    total, distinct = int(class_total.sum()), int(class_distinct.sum())
    alone = np.flatnonzero(kind < CLASSES - SHARED)
    np.subtract.at(class_total, CLASSES - SHARED + shared[alone], n[alone])
    np.subtract.at(class_distinct, CLASSES - SHARED + shared[alone], 1)
    class_total[kind[alone]] = n[alone]
    class_distinct[kind[alone]] = 1
    return Vocabulary(token, n, kind, least, total, distinct, class_total, class_distinct)


def contexts(kinds: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Classes one and two places before each token; CLASSES before the text."""
    place = np.arange(len(kinds)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = []
    for back in range(1, CONTEXT + 1):
        before = np.full(len(kinds), CLASSES, np.int64)
        before[back:] = kinds[:-back] if back < len(kinds) else kinds[:0]
        before[place < back] = CLASSES
        out.append(before)
    return out


def count_contexts(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(code, n) of every class with its context that occurs in ``docs``, over all positions.
    At most CLASSES * (CLASSES + 1) ** CONTEXT rows."""
    own = words.kind < CLASSES - SHARED
    small = replace(words, token=words.token[own], count=words.count[own], kind=words.kind[own])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, data, offsets in common.text_steps(batches, "text"):
            hashes, shared, bounds = tokens(data, offsets)
            kinds, _ = small.look_up(hashes, shared)
            code = kinds
            for before in contexts(kinds, bounds):
                code = code * (CLASSES + 1) + before
            held.append(np.unique(code.astype(np.int32), return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held = [_added_up(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield _codes_batch(held.pop())
                    size = 0
        if held:
            yield _codes_batch(_added_up(held))

    rows = docs.select("text").mapInArrow(counted, "code int, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = (np.concatenate(column) for column in zip(*parts))
    code, inverse = np.unique(code, return_inverse=True)
    return code, np.bincount(inverse, n).astype(np.int64)


def _codes_batch(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1].astype(np.int64))], ["code", "n"])


def deal(found: DataFrame, rows: int) -> tuple[DataFrame, int, int]:
    """(learner, code, n), the number of learners, and the most that a row of theirs weighs.
    Every count is dealt whole; large ones in parts, to as many learners as they have rows."""
    size = found.agg(F.count("*").alias("different"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    learners = max(1, -(-size.different // rows))
    most = max(1, -(-size.total // (learners * rows)))
    parts = F.least(F.ceil(F.col("n") / most), F.lit(learners)).cast("int")
    split = found.withColumn("parts", parts).select(
        "code", "n", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    n = F.floor(F.col("n") / F.col("parts")) + (F.col("part") < F.col("n") % F.col("parts")).cast("long")
    learner = F.pmod(F.xxhash64("code") + F.col("part"), F.lit(learners)).cast("int")
    return split.select(learner.alias("learner"), "code", n.cast("long").alias("n")), learners, most


def _shapes() -> list[tuple[int, ...]]:
    """Of the parameters, then of what AdaGrad has seen of each; a state is all in one array."""
    once = [(CLASSES + 1, DIMENSION), *[(DIMENSION, DIMENSION)] * CONTEXT, (CLASSES, DIMENSION), (CLASSES,)]
    return once * 2


def _packed(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts])


def _unpacked(state: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _shapes():
        size = int(np.prod(shape))
        out.append(state[at : at + size].reshape(shape).copy())
        at += size
    return out


def _start(share: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(3)

    def normal(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.1, shape).astype(np.float32)

    vectors, targets = normal(CLASSES + 1, DIMENSION), normal(CLASSES, DIMENSION)
    maps = [np.eye(DIMENSION, dtype=np.float32) / (k + 1) for k in range(CONTEXT)]
    parts = [vectors, *maps, targets, np.log(share).astype(np.float32)]
    return _packed([*parts, *[np.full_like(p, 1e-2) for p in parts]])


def _summed(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their place."""
    flat = (at[:, None] * DIMENSION + np.arange(DIMENSION)).ravel()
    return np.bincount(flat, values.ravel(), rows * DIMENSION).astype(np.float32).reshape(rows, DIMENSION)


def learn(
    state: np.ndarray, code: np.ndarray, n: np.ndarray, most: int, share: np.ndarray, seed: list[int], batch: int = 2048
) -> np.ndarray:
    """The state after one epoch of noise-contrastive estimation over the counted codes: tells
    each class from ``NOISE`` drawn from the classes' frequencies, which a batch shares;
    AdaGrad on all parameters.  A count above ``most`` is split into rows of equal weight."""
    rng = np.random.default_rng(seed)
    vectors, *maps, targets, bias = (parts := _unpacked(state))[: CONTEXT + 3]
    seen_vectors, *seen_maps, seen_targets, seen_bias = parts[CONTEXT + 3 :]
    log_noise = np.log(NOISE * share).astype(np.float32)
    cumulative = np.cumsum(share)
    rate = 0.15
    times = -(-n // most)
    weight = np.repeat((n / times).astype(np.float32), times)
    code = np.repeat(code, times)

    def step(values, seen, gradient):
        seen += gradient * gradient
        values -= rate * gradient / np.sqrt(seen)

    order = rng.permutation(len(code))
    for at in range(0, len(order), batch):
        rows = order[at : at + batch]
        target, before, w = code[rows].astype(np.int64), [], weight[rows]
        for _ in range(CONTEXT):
            before.append(target % (CLASSES + 1))
            target = target // (CLASSES + 1)
        before.reverse()
        noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), CLASSES - 1)
        seen = [vectors[b] for b in before]
        predicted = sum(x @ m for x, m in zip(seen, maps))
        true = (predicted * targets[target]).sum(axis=1) + bias[target] - log_noise[target]
        false = predicted @ targets[noise].T + bias[noise] - log_noise[noise]
        g_true = w * (1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1)
        g_false = w[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))
        g_predicted = g_true[:, None] * targets[target] + g_false @ targets[noise]
        size = np.float32(1 / w.sum())
        g_targets = _summed(target, g_true[:, None] * predicted, CLASSES)
        np.add.at(g_targets, noise, g_false.T @ predicted)
        g_bias = np.bincount(target, g_true, CLASSES).astype(np.float32)
        np.add.at(g_bias, noise, g_false.sum(axis=0))
        g_vectors = np.zeros_like(vectors)
        for k in range(CONTEXT):
            g_vectors += _summed(before[k], g_predicted @ maps[k].T, CLASSES + 1)
            step(maps[k], seen_maps[k], seen[k].T @ g_predicted * size)
        step(targets, seen_targets, g_targets * size * 30)
        step(vectors, seen_vectors, g_vectors * size * 30)
        step(bias, seen_bias, g_bias * size)
    return _packed([vectors, *maps, targets, bias, seen_vectors, *seen_maps, seen_targets, seen_bias])


_LEARNT = "part int, learner int, weight double, state binary"


def _averaged(found: pa.Table) -> tuple[float, np.ndarray]:
    """The weight, and the mean by weight of the states, whatever order they come in."""
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("learner", "weight", "state"))))
    weight = sum(w for _, w, _ in rows)
    return weight, sum(np.frombuffer(state, np.float32) * (w / weight) for _, w, state in rows)


def _learnt(part: int, learner: int, weight: float, state: np.ndarray) -> pa.Table:
    columns = [[part], [learner], [float(weight)], [state.astype(np.float32).tobytes()]]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "learner", "weight", "state"])


def train(found: DataFrame, words: Vocabulary, epochs: int = EPOCHS, rows: int | None = None) -> Model:
    """Learns from all of ``found``, the (code, n) of ``count_contexts``.  States go to the
    driver as means of about as many as there are means."""
    share = (words.class_total + 1.0) / (words.class_total.sum() + CLASSES)
    dealt, learners, most = deal(found, rows or LEARNER_ROWS)
    parts = int(np.ceil(np.sqrt(learners)))
    state = _start(share)

    def averaged(table: pa.Table) -> pa.Table:
        weight, mean = _averaged(table)
        part = table.column("part")[0].as_py()
        return _learnt(part, part, weight, mean)

    def epoch_of(state: np.ndarray, epoch: int) -> DataFrame:
        def learnt(table: pa.Table) -> pa.Table:
            learner = table.column("learner")[0].as_py()
            code, n = (table.column(c).to_numpy() for c in ("code", "n"))
            order = np.lexsort((n, code))  # the order of tasks has no influence
            after = learn(state, code[order], n[order], most, share, [3, epoch, learner])
            return _learnt(learner % parts, learner, n.sum(), after)

        return dealt.groupBy("learner").applyInArrow(learnt, _LEARNT)

    for epoch in range(epochs):
        states = epoch_of(state, epoch)
        if parts > 1:
            states = states.groupBy("part").applyInArrow(averaged, _LEARNT)
        table = states.toArrow()
        if table.num_rows:
            state = _averaged(table)[1].astype(np.float32)
    vectors, *maps, targets, bias = _unpacked(state)[: CONTEXT + 3]
    return Model(words, vectors, maps, targets, bias)


class Scorer:
    """A model with the constants it has worked out: of each context, the logarithm of the
    sum over all classes."""

    def __init__(self, model: Model):
        self.model = model
        self.mapped = [model.vectors @ m for m in model.maps]
        self.constants = np.full((CLASSES + 1) ** CONTEXT, np.nan, np.float32)

    def predicted(self, codes: np.ndarray) -> np.ndarray:
        out = 0
        for mapped in self.mapped:
            out = out + mapped[codes % (CLASSES + 1)]
            codes = codes // (CLASSES + 1)
        return out

    def log_probabilities(self, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token's class."""
        code = np.zeros(len(kinds), np.int64)
        for before in reversed(contexts(kinds, bounds)):
            code = code * (CLASSES + 1) + before
        new = np.unique(code[np.isnan(self.constants[code])])
        # Always as many rows: a product of another shape may round otherwise, and a
        # context's constant must not depend on the contexts that come with it.
        rows = np.zeros(CONSTANT_ROWS, np.int64)
        for at in range(0, len(new), CONSTANT_ROWS):
            part = new[at : at + CONSTANT_ROWS]
            rows[: len(part)] = part
            scores = self.predicted(rows) @ self.model.targets.T + self.model.bias
            top = scores.max(axis=1)
            total = np.exp(scores - top[:, None]).sum(axis=1)
            self.constants[part] = (top + np.log(total))[: len(part)]
        scores = np.empty(len(kinds))
        for at in range(0, len(kinds), 1 << 16):  # a long text in parts
            part = slice(at, at + (1 << 16))
            targets = self.model.targets[kinds[part]]
            scores[part] = np.einsum("ij,ij->i", self.predicted(code[part]), targets)
        return scores + self.model.bias[kinds] - self.constants[code]


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """The worker's scorer of a model; it keeps one."""
    if model.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.name] = Scorer(model)
    return _SCORERS[model.name]


# Scores.


def _partly_scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each text: what the tokens in the vocabulary give, and the others with
    how often they occur."""
    words = model.vocabulary
    class_size = words.class_total + 0.5 * (words.class_distinct + 1)
    shared_from = CLASSES - SHARED

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scorer(model)
        for batch, data, offsets in common.text_steps(batches, "text"):
            hashes, shared, bounds = tokens(data, offsets)
            different, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            kinds, counts = (x[inverse] for x in words.look_up(different, shared[first]))
            frequent = counts >= 0
            own_log = np.where(frequent, np.log10(np.maximum(counts, 0) + 0.5), 0.0)
            log_p = tool.log_probabilities(kinds, bounds) / _LN10
            # In a shared class: the token's part of it, whose counts may come later.
            apart = kinds >= shared_from
            log_p = log_p + np.where(apart, own_log - np.log10(class_size[kinds]), 0.0)

            def total(values: np.ndarray) -> np.ndarray:
                return np.add.reduceat(values, bounds[:-1])

            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            rare = np.flatnonzero(~frequent)
            order = rare[np.lexsort((inverse[rare], owner[rare]))]
            key_owner, key_token = owner[order], inverse[order]
            new = np.ones(len(order), bool)
            new[1:] = (key_owner[1:] != key_owner[:-1]) | (key_token[1:] != key_token[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(order)))
            lists = np.append(0, np.cumsum(np.bincount(key_owner[starts], minlength=batch.num_rows)))

            def listed(values: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(values))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.diff(bounds)),
                    pa.array(total((counts > 0).astype(np.int64))),
                    pa.array(total(own_log)),
                    pa.array(total(log_p)),
                    listed(different[key_token[starts]].view(np.int64)),
                    listed(times.astype(np.int32)),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
        "base double, score double, rare array<long>, times array<int>"
    )
    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(scored, schema)


def fit(training: DataFrame, counts: DataFrame) -> Model:
    words = vocabulary(counts)
    return train(common.stored(count_contexts(training, words), "context-counts"), words)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of
    ``docs`` (with held_out)."""
    words = model.vocabulary
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    parts = common.stored(_partly_scored(rows, model), "partly-scored")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("token"), F.col("x.times").alias("times")
    )
    others = counts.where(F.col("n") < words.least).select("token", "n")
    sums = (
        rare.join(others, "token", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    size = float(np.log10(words.total + 0.5 * (words.distinct + 1)))
    more = F.coalesce("rare_log", F.lit(0.0))
    return parts.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * size).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def learn_and_score(docs: DataFrame) -> DataFrame:
    """Learns from the rows outside the fold (crc32 modulo 5 is 1) and scores all rows."""
    rows = docs.select("doc_id", common.is_held_out("doc_id", 5, 1).alias("held_out"), "text")
    training = rows.where(~F.col("held_out"))
    counts = common.stored(count_tokens(training), "token-counts")
    return score(rows, fit(training, counts), counts)
