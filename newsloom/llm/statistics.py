"""Statistics of whole documents, for rules and classifiers over them."""

from __future__ import annotations

import numpy as np

from newsloom.llm import octets as o

WINDOW = 8

#: The counts the quality rules return.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: What the classifiers see: counts of the text, and shares that do not grow with it.
FEATURES = (
    "log_words", "log_lines", "mean_word", "long_words", "symbol_share", "dup_line_share",
    "repeat_share", "upper_share", "digit_share", "non_ascii_share", "stop_share",
    "bang_share", "pipe_share", "comma_share", "distinct_share", "line_words",
    "single_share", "upper_words", "bare_words", "dup_line_bytes",
)

_SYMBOL = o.byte_set(b"#*$%&|<>")
_UPPER = o.byte_set(range(65, 91))
_DIGIT = o.byte_set(range(48, 58))
_LETTER = o.byte_set([*range(65, 91), *range(97, 123), *range(128, 256)])
_STOP, _BANG, _PIPE, _COMMA = (o.byte_set(c) for c in (b".", b"!?", b"|", b",;:"))


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict, np.ndarray]:
    """Base counts by name and the matrix of FEATURES, one row per text."""
    rows = len(offsets) - 1

    def count(owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner, minlength=rows)

    inside = ~o.BLANK[data]
    starts, ends, owner = o.runs(inside, offsets)
    n_words = count(owner)
    heads = (data & 0xC0) != 0x80
    word_chars = o.per_row(heads & inside, offsets)
    n_symbols = o.per_row(_SYMBOL[data], offsets)
    hashes = o.span_hashes(data, starts, ends)

    # Words in windows that occur again in the same text.
    windows = o.window_hashes(hashes, WINDOW)
    n_repeat = np.zeros(rows, np.int64)
    if len(windows):
        whole = owner[: len(windows)] == owner[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        _, again = o.equal_earlier(owner[at], windows[at])
        steps = np.zeros(len(owner) + 1, np.int64)
        np.add.at(steps, at[again], 1)
        np.add.at(steps, at[again] + WINDOW, -1)
        n_repeat = count(owner[np.cumsum(steps)[:-1] > 0])

    # Lines with a word that equal an earlier line.
    lines, line_ends, line_owner = o.runs(data != 10, offsets)
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=words_before[1:])
    full = words_before[line_ends] > words_before[lines]
    lines, line_ends, line_owner = lines[full], line_ends[full], line_owner[full]
    earlier, _ = o.equal_earlier(line_owner, o.span_hashes(data, lines, line_ends))
    n_lines, n_dup = count(line_owner), count(line_owner[earlier])
    dup_bytes = np.bincount(
        line_owner[earlier], (line_ends - lines)[earlier].astype(float), minlength=rows
    )

    base = dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup, n_repeat)))
    seen, _ = o.equal_earlier(owner, hashes)
    n_distinct = n_words - count(owner[seen])
    length = ends - starts
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    bare = letters[ends] == letters[starts]
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=upper[1:])
    shout = (upper[ends] - upper[starts]) >= 2
    size = np.maximum(np.diff(offsets), 1)
    words, lines_or_1 = np.maximum(n_words, 1), np.maximum(n_lines, 1)

    def share(table: np.ndarray) -> np.ndarray:
        return o.per_row(table[data], offsets) / size

    columns = (
        np.log1p(n_words), np.log1p(n_lines), word_chars / words, count(owner[length >= 20]) / words,
        n_symbols / words, n_dup / lines_or_1, n_repeat / words, share(_UPPER), share(_DIGIT),
        o.per_row(~heads, offsets) / size, share(_STOP), share(_BANG), share(_PIPE), share(_COMMA),
        n_distinct / words, n_words / lines_or_1, count(owner[length == 1]) / words,
        count(owner[shout]) / words, count(owner[bare]) / words, dup_bytes / size,
    )
    return base, np.stack(columns, axis=1)
