"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of those of its hash and of the hashes of its first bytes,
so that inflected forms share some of it.  Filters of several widths slide over the whole
text, the largest response of each filter is kept, and a logistic unit scores those.  It is begun
on the driver by AdaGrad on a bounded sample of labelled documents, and goes on over all
others in ``LEARNERS`` tasks, whose changes other tasks average, a piece of the network each.  A tenth of all labelled documents
sets a threshold for each language; the language decides on a score, it is no input of one.

Defined results: NULL, empty and wordless texts are one padding word and get the score of
that; rows without id are scored, not held out and never learnt from; repeated rows get
equal scores; without labels every score is 0.5, with one class only it is near that
class; a NULL or unseen language has the default threshold; other columns are ignored.
Texts are taken whole, a step of text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import common
from newsloom.llm import octets as o

BUCKETS = 1 << 15
DIMENSION = 16
FILTERS = 16
WIDTHS = (1, 2, 3)
#: Hashes of a word: of the whole, and of as many first bytes.
PREFIXES = (4, 5)
PARTS = 1 + len(PREFIXES)
THRESHOLD = 0.3
#: Bounds of the sample that training begins with: documents, and words of them together.
MAX_TRAINING_ROWS = 16_000
MAX_TRAINING_WORDS = 8_000_000
#: Documents seen in training, over all epochs (4 to 20 of them).
VISITS = 64_000
#: Tasks that learn from the documents outside the sample, at most, and at least how many
#: documents each has; how many it learns from at a time, and how often in one round.
LEARNERS, LEARNER_ROWS = 32, 512
BLOCK_ROWS, PASSES = 256, 4
#: Rows of the embedding whose changes are averaged together.
PIECE_ROWS = 1024
#: Scores of documents outside the sample are counted in steps of one part in so many.
SCORE_STEPS = 10_000

_WORD = o.byte_set([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_PAD = max(WIDTHS) - 1
#: Words of a long text that are looked at together.
LONG = 1 << 17
#: A text of more words is learnt from by the windows of its largest responses.
LONG_TRAINING = 1 << 12


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of each text, (words, PARTS), and the n + 1 offsets; bucket 0 is
    padding."""
    starts, ends, owner = o.runs(_WORD[data], offsets)
    lower = o.LOWER[data]
    hashes = [o.span_hashes(lower, starts, ends)]
    for size in PREFIXES:
        prefix = o.span_hashes(lower, starts, np.minimum(starts + size, ends))
        hashes.append(o.mix(prefix + np.uint64(size)))
    buckets = (np.stack(hashes, axis=1) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    return buckets, np.append(0, np.cumsum(counts))


def padded(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end with padding behind each, so that no window reaches the next text;
    the place where each begins, and which places windows may begin at."""
    counts = np.diff(offsets)
    sizes = counts + _PAD + 1
    begins = np.cumsum(sizes) - sizes
    ids = np.zeros((int(sizes.sum()), PARTS), np.int64)
    place = np.arange(len(words)) + np.repeat(begins - offsets[:-1], counts)
    ids[place] = words
    valid = np.zeros(len(ids), bool)
    valid[place] = True
    valid[begins] = True  # also of a text without words
    return ids, begins, valid


@dataclass
class Network:
    embedding: np.ndarray  # (BUCKETS, DIMENSION)
    filters: list[np.ndarray]  # one (width, DIMENSION, FILTERS) for each width
    biases: list[np.ndarray]
    weights: np.ndarray  # (filters of all widths,)
    bias: float

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return sum(self.embedding[ids[..., part]] for part in range(PARTS))

    def responses(self, ids: np.ndarray, valid: np.ndarray) -> list[np.ndarray]:
        x = self.embed(ids)
        out = []
        for kernel, bias in zip(self.filters, self.biases):
            z = x @ kernel[0] + bias
            for k in range(1, len(kernel)):
                z[:-k] += x[k:] @ kernel[k]
            z[~valid] = -np.inf
            out.append(z)
        return out

    def score(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        if len(offsets) == 2:
            pooled = self.largest_of_one(words)
        else:
            pooled = self.largest(*padded(words, offsets))
        raw = np.maximum(pooled, 0) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30)))

    def largest(self, ids: np.ndarray, begins: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text."""
        pooled = [np.maximum.reduceat(z, begins, axis=0) for z in self.responses(ids, valid)]
        return np.concatenate(pooled, axis=1)

    def largest_of_one(self, words: np.ndarray) -> np.ndarray:
        """The same of one text, however long, in parts that see the words behind them."""
        best = np.full((1, len(self.weights)), -np.inf, np.float32)
        for at in range(0, max(len(words), 1), LONG):
            part = words[at : at + LONG + _PAD]
            ids, begins, valid = padded(part, np.array([0, len(part)]))
            if at + LONG < len(words):
                valid[LONG:] = False
            best = np.maximum(best, self.largest(ids, begins, valid))
        return best

    def strongest_windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one text, however long, the windows with the largest response of each filter,
        as ids and the places they begin at: all that a gradient of its score goes through."""
        best = np.full(len(self.weights), -np.inf, np.float32)
        place = np.zeros(len(self.weights), np.int64)
        for at in range(0, max(len(words), 1), LONG):
            part = words[at : at + LONG + _PAD]
            ids, _, valid = padded(part, np.array([0, len(part)]))
            if at + LONG < len(words):
                valid[LONG:] = False
            responses = self.responses(ids, valid)
            top = np.concatenate([z.argmax(axis=0) for z in responses])
            largest = np.concatenate([z.max(axis=0) for z in responses])
            place = np.where(largest > best, at + top, place)
            best = np.maximum(best, largest)
        around = np.unique(place)[:, None] + np.arange(_PAD + 1)
        inside = around < len(words)
        ids = np.zeros((*around.shape, PARTS), np.int64)
        ids[inside] = words[around[inside]]
        valid = np.zeros(around.shape, bool)
        valid[:, 0] = True
        return ids.reshape(-1, PARTS), valid.ravel()


def new_network(seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    embedding = normal(BUCKETS, DIMENSION, scale=0.1)
    embedding[0] = 0
    return Network(
        embedding,
        [normal(w, DIMENSION, FILTERS, scale=(w * DIMENSION) ** -0.5) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        normal(len(WIDTHS) * FILTERS, scale=0.1),
        0.0,
    )


def _together(net: Network, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Texts end to end, long ones by their strongest windows; the places that windows may
    begin at, and where each text ends."""
    pieces = []
    for words in texts:
        if len(words) > LONG_TRAINING:
            pieces.append(net.strongest_windows(words))
        else:
            ids, _, valid = padded(words, np.array([0, len(words)]))
            pieces.append((ids, valid))
    ids, valid = (np.concatenate(column) for column in zip(*pieces))
    return ids, valid, np.cumsum([len(piece[0]) for piece in pieces]).tolist()


def epochs_for(n: int, visits: int = VISITS) -> int:
    return min(max(-(-visits // max(n, 1)), 4), 20)


def train(
    texts: list[np.ndarray], y: np.ndarray, visits: int = VISITS, batch: int = 32, rate: float = 0.1
) -> Network:
    """Fits the log-loss; the gradient goes through the place of each filter's maximum."""
    epochs = epochs_for(len(texts), visits)
    net = new_network()
    if len(y) == 0 or y.min() == y.max():
        net.weights[:] = 0
        net.bias = 0.0 if len(y) == 0 else float(np.clip(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), -7, 7))
        return net
    net.bias = float(np.log(y.mean() / (1 - y.mean())))
    return Trainer(net, batch, rate).learn(texts, y, epochs)


class Trainer:
    """A network under training, with the squares of the gradients it has had."""

    def __init__(self, net: Network, batch: int = 32, rate: float = 0.1):
        self.net, self.batch, self.rate = net, batch, rate
        self.rng = np.random.default_rng(5)
        self.seen: dict[str, np.ndarray | float] = {}
        self.seen_rows = np.full((BUCKETS, 1), 1e-3, np.float32)

    def _step(self, name: str, value, gradient):
        self.seen[name] = self.seen.get(name, 1e-3) + gradient * gradient
        return value - self.rate * gradient / np.sqrt(self.seen[name])

    def learn(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 1) -> Network:
        net, batch, rate, step, seen_rows = self.net, self.batch, self.rate, self._step, self.seen_rows
        for _ in range(epochs):
            order = self.rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                ids, valid, ends = _together(net, [texts[i] for i in chosen])
                places, pooled = [], []
                spans = list(zip([0, *ends], ends))
                for z in net.responses(ids, valid):
                    top = np.stack([b + z[b:e].argmax(axis=0) for b, e in spans])
                    places.append(top)
                    pooled.append(np.take_along_axis(z, top, axis=0))
                h = np.concatenate(pooled, axis=1)
                active = np.maximum(h, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ net.weights + net.bias, -30, 30)))
                error = ((p - y[chosen]) / len(chosen)).astype(np.float32)
                back = error[:, None] * net.weights * (h > 0)
                rows_changed, changes = [], []
                for w, kernel in enumerate(net.filters):
                    g = back[:, w * FILTERS : (w + 1) * FILTERS]
                    gradient = np.empty_like(kernel)
                    for k in range(len(kernel)):
                        at_words = ids[places[w] + k]
                        gradient[k] = np.einsum("df,dfe->ef", g, net.embed(at_words))
                        change = (g[:, :, None] * kernel[k].T[None]).reshape(-1, DIMENSION)
                        for part in range(PARTS):
                            rows_changed.append(at_words[..., part].ravel())
                            changes.append(change)
                    net.filters[w] = step(f"filter{w}", kernel, gradient)
                    net.biases[w] = step(f"bias{w}", net.biases[w], g.sum(axis=0))
                net.weights = step("weights", net.weights, active.T @ error)
                net.bias = float(step("bias", net.bias, error.sum()))
                rows, inverse = np.unique(np.concatenate(rows_changed), return_inverse=True)
                total = np.zeros((len(rows), DIMENSION), np.float32)
                np.add.at(total, inverse, np.concatenate(changes))
                seen_rows[rows] += (total * total).mean(axis=1, keepdims=True)
                net.embedding[rows] -= rate * total / np.sqrt(seen_rows[rows])
                net.embedding[0] = 0
        return net


@dataclass
class Classifier:
    network: Network
    thresholds: dict[str, float]  # by language
    default: float


def best_threshold(scores: np.ndarray, y: np.ndarray, default: float) -> float:
    """The middle between two scores that divides best (largest F1); ``default`` if there is
    only one class."""
    if len(y) == 0 or y.min() == y.max():
        return default
    return threshold_of_counts(scores, np.ones(len(y)), y, default)


def threshold_of_counts(scores: np.ndarray, n: np.ndarray, hits: np.ndarray, default: float) -> float:
    """The same from the number of documents with each score, and of those with label 1."""
    if not 0 < hits.sum() < n.sum():
        return default
    order = np.argsort(-scores, kind="stable")
    s, found = scores[order], np.cumsum(hits[order])
    f1 = 2 * found / (np.cumsum(n[order]) + hits.sum())
    last = np.append(s[1:] != s[:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    below = s[at + 1] if at + 1 < len(s) else 0.0
    return float((s[at] + below) / 2)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_TRAINING_ROWS,
    max_words: int = MAX_TRAINING_WORDS,
    threshold: float = THRESHOLD,
) -> Classifier:
    """Network and thresholds from ``labels.toxic`` of all documents outside the held-out fold.

    Training begins with a sample by hash of at most ``max_rows`` of them with ``max_words``
    words together (the first one whatever its length), and goes on over the others where
    they are.  Texts are learnt from whole."""
    # An id and a number for each label: texts stay where they are.
    known = F.broadcast(common.labelled(labels, "toxic"))
    rows = docs.select("doc_id", "lang", "text").join(known, "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(batches, "text"):
            words, ends = hashed_words(data, offsets)
            flat = pa.array(words.ravel().astype(np.int16))  # below BUCKETS
            lists = pa.ListArray.from_arrays(pa.array(PARTS * ends, pa.int32()), flat)
            columns = [batch.column(c) for c in ("doc_id", "lang", "label")]
            yield pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "lang", "label", "words"])

    kind = dict(docs.dtypes)["doc_id"]
    found = rows.mapInArrow(hashed, f"doc_id {kind}, lang string, label int, words array<smallint>")
    found = common.stored(found.withColumn("content", F.xxhash64("lang", "words")), "hashed-words")
    # Which rows are in the sample is worked out without their words: few numbers of each.
    sizes = found.groupBy("doc_id", "content").agg(F.max(F.size("words") / PARTS).alias("n"))
    by_hash = sizes.orderBy(F.xxhash64("doc_id", "content"), "doc_id").limit(max_rows)
    order = Window.orderBy(F.xxhash64("doc_id", "content"), "doc_id")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    kept = by_hash.withColumn("before", before).where((F.col("before") + F.col("n") <= max_words) | (F.col("before") == 0))
    in_sample = common.stored(kept.select("doc_id", "content"), "sample")
    chosen = found.join(F.broadcast(in_sample), ["doc_id", "content"])
    others = found.join(F.broadcast(in_sample), ["doc_id", "content"], "left_anti")
    # Copies of a row are one, whichever task has read it first.
    table = chosen.dropDuplicates(["doc_id", "content"]).toArrow()
    # The words stay where they came; only the keys are put in order.
    order = table.select(["doc_id", "content"]).append_column("at", pa.array(np.arange(len(table))))
    order = np.asarray(order.sort_by([("doc_id", "ascending"), ("content", "ascending")]).column("at"))
    texts = [words for batch in table.to_batches() for words in _word_lists(batch)]
    texts = [texts[at] for at in order]
    y = np.asarray(table.column("label"), float)[order]
    langs = np.array([lang or "" for lang in table.column("lang").to_pylist()], object)[order]
    # Every tenth document sets the thresholds and is not learnt from.
    tuning = np.arange(len(y)) % 10 == 0
    network = train([t for t, out in zip(texts, tuning) if not out], y[~tuning])
    # Of the sample, only these are still needed.
    kept = [t.copy() for t, out in zip(texts, tuning) if out]
    del table, texts
    # So does every tenth of the others.
    is_tuning = F.pmod(F.xxhash64("content", "doc_id"), F.lit(10)) == 0
    learnt_from = others.where(~is_tuning)
    n = others.agg(F.count_if(~is_tuning).alias("n")).first().n
    for _ in range(-(-epochs_for(n) // PASSES) if n else 0):
        network = learnt_on(network, learnt_from, min(-(-n // LEARNER_ROWS), LEARNERS))
    # A few at a time: the responses to a word take more room than the word.
    parts = [np.zeros(0)]
    at = 0
    while at < len(kept):
        some = [kept[at]]
        while len(some) < 32 and at + len(some) < len(kept) and sum(map(len, some)) < LONG_TRAINING:
            some.append(kept[at + len(some)])
        offsets = np.append(0, np.cumsum([len(t) for t in some]))
        parts.append(network.score(np.concatenate(some), offsets))
        at += len(some)
    scores = np.concatenate(parts)
    counts = score_counts(network, others.where(is_tuning))
    if not counts:
        by_lang = {
            str(lang): best_threshold(scores[langs[tuning] == lang], y[tuning][langs[tuning] == lang], threshold)
            for lang in set(langs[tuning])
        }
        return Classifier(network, by_lang, threshold)
    by_lang = {}
    for lang in {*langs[tuning], *counts}:
        own = langs[tuning] == lang
        steps, n, hits = counts.get(lang, np.zeros((3, 0)))
        by_lang[str(lang)] = threshold_of_counts(
            np.append(scores[own], steps / SCORE_STEPS), np.append(np.ones(own.sum()), n), np.append(y[tuning][own], hits), threshold
        )
    return Classifier(network, by_lang, threshold)


def _arrays(net: Network) -> list[np.ndarray]:
    return [net.embedding, *net.filters, *net.biases, net.weights, np.array([net.bias], np.float32)]


def _network(arrays: list[np.ndarray]) -> Network:
    widths = len(WIDTHS)
    embedding, dense = arrays[0], arrays[1:]
    return Network(embedding, dense[:widths], dense[widths : 2 * widths], dense[-2], float(dense[-1][0]))


def _word_lists(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(w.values).reshape(-1, PARTS) for w in batch.column("words")]


def learnt_on(network: Network, rows: DataFrame, learners: int) -> Network:
    """``network`` after one round over all of ``rows`` (doc_id, content, label, words).

    So many tasks begin with it, each goes through its share in the order of hashes, a
    block at a time, and their changes are averaged: those of an embedding over the
    learners that have met it.  Copies are learnt from once: the order brings them together.
    The changes are averaged in tasks, a piece of them in each; the driver gets their means."""
    start = _arrays(network)
    # The rows of the embedding in pieces, then all that is not embedding.
    size, step = start[0].size, PIECE_ROWS * DIMENSION
    ends = [*range(step, size, step), size, sum(a.size for a in start)]

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(_network([a.copy() for a in start]))
        texts: list[np.ndarray] = []
        y: list[int] = []
        n, last = 0, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "content")))
            for key, words, label in zip(keys, _word_lists(batch), batch.column("label").to_pylist()):
                if key == last:
                    continue
                last = key
                texts.append(words)
                y.append(label)
                if len(texts) == BLOCK_ROWS:
                    trainer.learn(texts, np.array(y, float), PASSES)
                    n, texts, y = n + len(texts), [], []
        if texts:
            trainer.learn(texts, np.array(y, float), PASSES)
            n += len(texts)
        if n:
            changes = [b - a for a, b in zip(start, _arrays(trainer.net))]
            flat = np.concatenate([c.ravel() for c in changes]).astype(np.float32)
            name = hashlib.sha256(flat.tobytes()).hexdigest()
            pieces = [flat[a:b].tobytes() for a, b in zip([0, *ends], ends)]
            columns = [pa.array(range(len(ends)), pa.int32()), pa.array([n] * len(ends), pa.int64())]
            columns += [pa.array([name] * len(ends)), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "n", "learner", "changes"])

    def averaged(group: pa.Table) -> pa.Table:
        """One piece of all learners: at most ``LEARNERS`` times its size."""
        group = group.sort_by([("n", "ascending"), ("learner", "ascending")])
        moves = [np.frombuffer(blob.as_py(), np.float32) for blob in group.column("changes")]
        n = np.asarray(group.column("n"), float)
        piece = group.column("piece")[0].as_py()
        if piece < len(ends) - 1:
            moves = [m.reshape(-1, DIMENSION) for m in moves]
            met = sum((m != 0).any(axis=1, keepdims=True) for m in moves)
            change = sum(moves) / np.maximum(met, 1)
        else:
            change = sum(w * m for w, m in zip(n / n.sum(), moves))
        blob = np.asarray(change, float).tobytes()
        return pa.table({"piece": pa.array([piece], pa.int32()), "change": pa.array([blob], pa.binary())})

    order = F.xxhash64("doc_id", "content")
    dealt = rows.repartition(learners, order).sortWithinPartitions(order, "doc_id", "content")
    changed = dealt.select("doc_id", "content", "label", "words").mapInArrow(
        learnt, "piece int, n long, learner string, changes binary"
    )
    # The size of the network, however many learners there are.
    found = changed.groupBy("piece").applyInArrow(averaged, "piece int, change binary").collect()
    if not found:
        return network
    change = np.concatenate([np.frombuffer(row.change) for row in sorted(found, key=lambda row: row.piece)])
    moves = np.split(change, np.cumsum([a.size for a in start])[:-1])
    return _network([(a + move.reshape(a.shape)).astype(np.float32) for a, move in zip(start, moves)])


def score_counts(network: Network, rows: DataFrame) -> dict[str, np.ndarray]:
    """By language: steps of scores, number of ``rows`` with such a score, and those with label 1."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = []
            for words in _word_lists(batch):
                score = network.score(words, np.array([0, len(words)]))[0]
                steps.append(int(round(float(score) * SCORE_STEPS)))
            columns = [batch.column(c) for c in ("doc_id", "content", "lang", "label")]
            names = ["doc_id", "content", "lang", "label", "step"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(steps, pa.int32())], names)

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, content long, lang string, label int, step int"
    steps = rows.select("doc_id", "content", "lang", "label", "words").mapInArrow(scored, schema)
    counted = steps.dropDuplicates(["doc_id", "content"]).groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "step").agg(
        F.count("*").alias("n"), F.sum("label").alias("hits")
    )
    out: dict[str, list] = {}
    for row in counted.collect():
        out.setdefault(row.lang, []).append((row.step, row.n, row.hits))
    return {lang: np.array(sorted(found), float).T for lang, found in out.items()}


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (by ``threshold``) and toxic (by the threshold of
    the row's language) of every row of ``docs``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.text_steps(batches, "text"):
            scores = model.network.score(*hashed_words(data, offsets))
            cuts = [model.thresholds.get(x or "", model.default) for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                    pa.array(scores >= np.array(cuts)),
                ],
                ["doc_id", "held_out", "score", "predicted", "toxic"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(
        "doc_id", "lang", common.is_held_out("doc_id", 4, 2).alias("held_out"), "text"
    )
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, toxic boolean"
    return rows.mapInArrow(scored, schema)
