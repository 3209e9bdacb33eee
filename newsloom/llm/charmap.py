"""The compiled character map of a SentencePiece model: longest-prefix normalisation that
keeps, for every normalised byte, the original byte it came from."""

from __future__ import annotations

import numpy as np

SPACE = "▁"  # what a space becomes inside pieces


class CharMap:
    """A double-array trie over byte strings, and the strings they are replaced by.

    The blob holds the trie's size in bytes, the trie's 32-bit units and the replacements,
    each ended by a zero byte.  The layout of a unit is fixed by the format: bit 8 says
    that a value follows, bits 0-7 and 31 are the label, bits 10-30 the offset, shifted by
    eight more if bit 9 is set.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement of the longest known prefix of ``data[at:]`` and that prefix's length."""
        units = self.units
        if not units:
            return None
        found, length = -1, 0
        node = self._child(0, units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                found, length = units[node] & 0x7FFFFFFF, i + 1 - at
        if not length:
            return None
        return self.replacements[found : self.replacements.index(b"\0", found)], length

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


def char_length(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def normalise(
    text: str, charmap: CharMap, dummy_prefix: bool, squeeze: bool
) -> tuple[str, np.ndarray]:
    """Normalised text, with spaces as the space symbol, and the alignment: the original
    byte of each of its UTF-8 bytes, with one entry more for its end.

    ``dummy_prefix`` puts a space in front, ``squeeze`` drops spaces at both ends and all
    but one inside.  A replaced prefix is aligned to its first byte as a whole.
    """
    data = text.encode()
    parts: list[tuple[bytes, int, int]] = []  # replacement, begin and end in the original
    at = 0
    while at < len(data):
        new, length = charmap.longest(data, at) or (None, char_length(data[at]))
        parts.append((data[at : at + length] if new is None else new, at, at + length))
        at += length
    if squeeze:
        parts = _squeezed(parts)
    if not parts:
        return "", np.zeros(1, np.int64)
    symbol = SPACE.encode()
    out, aligned = [], []
    if dummy_prefix:
        out.append(symbol)
        aligned += [parts[0][1]] * len(symbol)
    for new, begin, end in parts:
        new = new.replace(b" ", symbol)
        out.append(new)
        # A character that stays itself keeps the places of its bytes.
        same = len(new) == end - begin and new == data[begin:end]
        aligned += range(begin, end) if same else [begin] * len(new)
    aligned.append(parts[-1][2])
    return b"".join(out).decode("utf-8", "replace"), np.array(aligned, np.int64)


def _squeezed(parts: list[tuple[bytes, int, int]]) -> list[tuple[bytes, int, int]]:
    out: list[tuple[bytes, int, int]] = []
    after_space = True
    for new, begin, end in parts:
        if after_space:
            new = new.lstrip(b" ")
        if new:
            out.append((new, begin, end))
            after_space = new.endswith(b" ")
    while out and out[-1][0].endswith(b" "):
        new, begin, end = out.pop()
        if new.rstrip(b" "):
            out.append((new.rstrip(b" "), begin, end))
    return out
