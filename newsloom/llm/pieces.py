"""SentencePiece encoding and decoding with the byte span of every piece.

Texts are normalised by the model's character map with their alignment (``charmap``),
cut where no piece can cross, and the cut segments that are not known yet are merged all
together in numpy, best pair first, as the model's scores order them.  Each piece is
projected through the alignment to its bytes in the original text.

Defined results: NULL and empty texts have the begin and end ids only and decode to the
empty text; repeated rows get equal results; a text without spaces, however long, is one
segment merged with a heap; characters the vocabulary lacks become one piece a byte;
other columns are ignored.  Texts are taken whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_format

from newsloom.llm import charmap, common

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces, fixed by the model format
BPE = 2
#: Segments remembered by a worker; all are forgotten when there are more.
REMEMBERED = 400_000
#: Longer segments are merged one at a time.
TOGETHER = 48
#: Characters of a text above which its segments are taken a portion at a time.
LONG = 1 << 20
_SHIFT = 21  # symbols are below 2^21: ids, then unknown characters by code point


class Codec:
    """Encoder and decoder of one model, without sampling."""

    def __init__(self, model: bytes):
        proto = model_format.ModelProto()
        proto.ParseFromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if (
            trainer.model_type != BPE
            or not trainer.byte_fallback
            or trainer.treat_whitespace_as_suffix
            or not spec.escape_whitespaces
            or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        ):
            raise ValueError("only BPE models with byte fallback and no own symbols are read")
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self.dummy_prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.charmap = charmap.CharMap(spec.precompiled_charsmap)
        self.identity = not self.charmap.units and not self.squeeze
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_ids = np.zeros(256, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        self._read_merges(proto, normal)
        self._read_decoding(proto)
        self._segments = self._segment_pattern(normal)
        self._known: dict[str, bytes] = {}

    def _read_merges(self, proto, normal: dict[str, int]) -> None:
        """Every pair of symbols that makes a piece, sorted, with the piece and its score."""
        n = len(proto.pieces)
        chars = sorted({c for piece in normal for c in piece})
        self.symbol = {c: normal.get(c, n + i) for i, c in enumerate(chars)}
        self.unknown = n + len(chars)  # symbols from here on: characters not in any piece
        if self.unknown + 0x110000 >= 1 << _SHIFT:
            raise ValueError("the vocabulary is too large")
        self.symbol_of = np.arange(self.unknown, self.unknown + 0x110000, dtype=np.int64)
        self.symbol_of[[ord(c) for c in chars]] = [self.symbol[c] for c in chars]
        keys, made = [], []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                left = self.symbol[a] if cut == 1 else normal.get(a)
                right = self.symbol[b] if cut == len(piece) - 1 else normal.get(b)
                if left is not None and right is not None:
                    keys.append(left << _SHIFT | right)
                    made.append(i)
        order = np.argsort(keys)
        self.pair_keys = np.array([*np.array(keys, np.int64)[order], 1 << 62], np.int64)
        self.pair_made = np.array([*np.array(made, np.int64)[order], -1], np.int64)
        # Scores as dense ranks: the larger the better, equal for equal scores.
        scores = np.array([p.score for p in proto.pieces])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        self.lone = {n + i: c for i, c in enumerate(chars) if c not in normal}

    def _read_decoding(self, proto) -> None:
        texts, first_space = [], []
        for i, p in enumerate(proto.pieces):
            if p.type == CONTROL:
                text = b""
            elif p.type == BYTE:
                text = bytes([int(p.piece[1:-1], 16)])
            elif p.type == UNKNOWN:
                text = proto.trainer_spec.unk_surface.encode()
            else:
                text = p.piece.replace(charmap.SPACE, " ").encode()
            texts.append(text)
            first_space.append(p.type == NORMAL and p.piece.startswith(charmap.SPACE))
        self.decoded = np.frombuffer(b"".join(texts), np.uint8)
        self.decoded_size = np.array([len(t) for t in texts], np.int64)
        self.decoded_start = np.cumsum(self.decoded_size) - self.decoded_size
        self.first_space = np.array(first_space)
        # Bytes of a piece in the normalised text.
        self.normal_size = np.array(
            [1 if p.type == BYTE else 0 if p.type == CONTROL else len(p.piece.encode()) for p in proto.pieces]
        )

    def _segment_pattern(self, normal: dict[str, int]) -> re.Pattern:
        """Cuts before runs of spaces if no piece has a space behind other characters, and
        around characters that are in no piece of several."""
        joined = {c for piece in normal if len(piece) > 1 for c in piece}
        alone = "".join(c for c in map(chr, range(128)) if c not in joined)
        single = f"[{re.escape(alone)}]" if alone else "(?!)"
        others = f"[^{charmap.SPACE}{re.escape(alone)}]"
        if any(charmap.SPACE in piece.lstrip(charmap.SPACE) for piece in normal):
            return re.compile(f"[^{re.escape(alone)}]+|{single}" if alone else "(?s:.+)")
        return re.compile(f"{charmap.SPACE}*{others}+|{charmap.SPACE}+|{single}")

    # Encoding.

    def normalised(self, text: str) -> str:
        if self.identity:
            prefix = charmap.SPACE if self.dummy_prefix and text else ""
            return prefix + text.replace(" ", charmap.SPACE)
        return charmap.normalise(text, self.charmap, self.dummy_prefix, self.squeeze)[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with begin and end."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        out: list[list[bytes]] = [[begin] for _ in texts]
        for rows, cut in self._portions(texts):
            self._learn_new(cut)
            for row, segments in zip(rows, cut):
                out[row].append(b"".join(map(self._known.__getitem__, segments)))
        return [np.frombuffer(b"".join([*parts, end]), "<u4") for parts in out]

    def _portions(self, texts: list[str]) -> Iterator[tuple[list[int], list[list[str]]]]:
        """Segments of all short texts together, and of each long one a portion at a time."""
        short = [row for row, text in enumerate(texts) if len(text) <= LONG]
        yield short, [self._segments.findall(self.normalised(texts[row])) for row in short]
        for row, text in enumerate(texts):
            if len(text) > LONG:
                found = self._segments.finditer(self.normalised(text))
                while portion := [match[0] for match in islice(found, LONG // 8)]:
                    yield [row], [portion]

    def _learn_new(self, cut: list[list[str]]) -> None:
        here = set().union(*cut)
        new = here.difference(self._known)
        if new:
            if len(self._known) + len(new) > REMEMBERED:
                self._known.clear()
                new = here
            self._learn(list(new))

    def _learn(self, segments: list[str]) -> None:
        segments.sort(key=len)
        lengths = np.array([len(s) for s in segments])
        long_from = int(np.searchsorted(lengths, TOGETHER, "right"))
        for s in segments[long_from:]:
            self._known[s] = self._ids(self._merge_one(self._symbols(s)))
        done = 0
        while done < long_from:  # similar lengths together, in bounded matrices
            width = int(lengths[done]) + 3
            end = min(int(np.searchsorted(lengths, width, "right")), done + 20_000, long_from)
            self._merge_together(segments[done:end])
            done = end

    def _symbols(self, segment: str) -> list[int]:
        get, unknown = self.symbol.get, self.unknown
        return [get(c, unknown + ord(c)) for c in segment]

    def _ids(self, symbols: list[int]) -> bytes:
        out: list[int] = []
        n = len(self.rank)
        for s in symbols:
            if s < n:
                out.append(s)
            else:
                char = self.lone[s] if s < self.unknown else chr(s - self.unknown)
                out.extend(self.byte_ids[list(char.encode())].tolist())
        return np.array(out, "<u4").tobytes()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair makes, or -1."""
        keys = left << _SHIFT | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_made[at], -1)

    def _merge_together(self, segments: list[str]) -> None:
        """One merge in every segment at a time, until no segment has a pair to merge."""
        n, width = len(segments), len(segments[-1])
        size = np.array([len(s) for s in segments])
        symbols = np.full((n, width + 1), -1, np.int64)
        points = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")
        symbols[np.arange(width + 1) < size[:, None]] = self.symbol_of[points]
        left, right = symbols[:, :-1], symbols[:, 1:]
        made = np.where(right >= 0, self._pairs(np.maximum(left, 0), np.maximum(right, 0)), -1)
        rank = np.where(made >= 0, self.rank[made], -1)
        rows, places = np.arange(n), np.arange(width + 1)
        final = symbols.copy()
        while len(rows):
            best = np.argmax(rank, axis=1)  # the first of equal ones
            each = np.arange(len(rows))
            more = rank[each, best] >= 0
            final[rows[~more]] = symbols[~more]
            rows, symbols, made, rank, best = (x[more] for x in (rows, symbols, made, rank, best))
            if not len(rows):
                break
            each = np.arange(len(rows))
            symbols[each, best] = made[each, best]
            shift = np.minimum(places + (places > best[:, None]), width)
            symbols = np.take_along_axis(symbols, shift, axis=1)
            symbols[:, -1] = -1
            made = np.take_along_axis(made, np.minimum(shift[:, :-1], width - 1), axis=1)
            made[:, -1] = -1
            for at in (best, best - 1):
                ok = at >= 0
                a, b = symbols[each, at], symbols[each, np.minimum(at + 1, width)]
                ok &= b >= 0
                pair = np.where(ok, self._pairs(np.maximum(a, 0), np.maximum(b, 0)), -1)
                keep = at >= 0
                last = np.minimum(at, width - 1)
                made[each[keep], last[keep]] = pair[keep]
            rank = np.where(made >= 0, self.rank[made], -1)
        self._remember(segments, final)

    def _remember(self, segments: list[str], final: np.ndarray) -> None:
        known, n = self._known, len(self.rank)
        odd = (final >= n).any(axis=1)
        for i in np.flatnonzero(odd):
            known[segments[i]] = self._ids([s for s in final[i].tolist() if s >= 0])
        plain = np.flatnonzero(~odd)
        if len(plain):
            used = final[plain] >= 0
            blob = final[plain][used].astype("<u4").tobytes()
            ends = (np.cumsum(used.sum(axis=1)) * 4).tolist()
            start = 0
            for i, end in zip(plain.tolist(), ends):
                known[segments[i]] = blob[start:end]
                start = end

    def _merge_one(self, symbols: list[int]) -> list[int]:
        """The same merges in one long segment, with a heap of pairs."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs = self._pairs(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        heap = [
            (-int(self.rank[p]), i, symbols[i], symbols[i + 1], int(p))
            for i, p in enumerate(pairs.tolist())
            if p >= 0
        ]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = piece, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    made = self._pair(symbols[x], symbols[y])
                    if made >= 0:
                        heapq.heappush(heap, (-int(self.rank[made]), x, symbols[x], symbols[y], made))
        return [s for s in symbols if s >= 0]

    def _pair(self, left: int, right: int) -> int:
        key = left << _SHIFT | right
        at = int(np.searchsorted(self.pair_keys, key))
        return int(self.pair_made[at]) if self.pair_keys[at] == key else -1

    # Spans and decoding.

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and the byte after the last, in the original text, of every id; begin
        and end have empty spans.  The spans cover the text in order."""
        ends = np.cumsum(self.normal_size[ids])
        starts = ends - self.normal_size[ids]
        if self.identity:
            raw = np.frombuffer(text.encode(), np.uint8)
            # Each original byte is one normalised byte, but for a space: it is three.
            sizes = np.where(raw == 32, 3, 1)
            prefix = 3 if self.dummy_prefix and len(raw) else 0
            firsts = prefix + np.cumsum(sizes) - sizes
            return np.searchsorted(firsts, starts), np.searchsorted(firsts, ends)
        _, aligned = charmap.normalise(text, self.charmap, self.dummy_prefix, self.squeeze)
        return aligned[starts], aligned[ends]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of the ids."""
        sizes = self.decoded_size[ids]
        total = int(sizes.sum())
        if not total:
            return b""
        ends = np.cumsum(sizes)
        index = np.repeat(self.decoded_start[ids] - (ends - sizes), sizes) + np.arange(total)
        out = self.decoded[index]
        first = int(np.argmax(sizes > 0))
        if (self.dummy_prefix or self.squeeze) and self.first_space[ids[first]]:
            out = out[1:]
        return out.tobytes()


@functools.lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    """The model file, read on the driver and sent with the tasks (half a megabyte)."""
    return Path(path).read_bytes()


def public_model() -> str:
    """Path of the public model the contract names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, the begin and end byte of each id in the original text, and the decoded
    text of every row of ``docs``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch, texts in _texts(batches):
            ids = tool.encode(texts)
            spans = [tool.spans(t, i) for t, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
                    pa.array([s[0] for s in spans], pa.list_(pa.int64())),
                    pa.array([s[1] for s in spans], pa.list_(pa.int64())),
                    pa.array([tool.decode(i).decode("utf-8", "replace") for i in ids]),
                ],
                ["doc_id", "ids", "begins", "ends", "decoded"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids array<int>, begins array<long>, ends array<long>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(encoded, schema)


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """The same encoding as numbers and hashes: doc_id, n_tokens, ids_sha256,
    decoded_sha256, and span_bytes, the original bytes that the spans cover."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch, texts in _texts(batches):
            ids = tool.encode(texts)
            covered = []
            for text, i in zip(texts, ids):
                begins, ends = tool.spans(text, i)
                covered.append(int((ends - begins).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(tool.decode(i)).hexdigest() for i in ids]),
                    pa.array(covered, pa.int64()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"
    return docs.select("doc_id", "text").mapInArrow(digested, schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch, _, _ in common.text_steps(batches, "text"):
        yield batch, [t or "" for t in batch.column("text").to_pylist()]
