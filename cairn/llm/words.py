"""Words of many texts at once, in numpy: where they stand, and 64-bit hashes of them and of runs of them.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and
carriage return, which is what ``bytes.split`` gives. Hashes only route rows and find
candidates; what is equal is decided on the words themselves.
"""

from __future__ import annotations

import numpy as np

#: An odd multiplier of 64 bits, 2**64 divided by the golden ratio, and bases of polynomials.
MIX = np.uint64(0x9E3779B97F4A7C15)
BYTES, GRAM, RUN = 0x100000001B3, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of one text that are hashed at a time.
SEGMENT = 4 << 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown as needed and kept."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 2 * n)
            self.up, self.down = _powers(size, self.base), _powers(size, pow(self.base, -1, 1 << 64))
        return self.up, self.down


def mix(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    x ^= x >> np.uint64(32)
    return x * MIX


class Words:
    """The words of ``texts``: begin and end in ``data``, hash, and the text each is of; ``first[i]`` to ``first[i + 1]`` are those of text i."""

    _bytes, _runs = Powers(BYTES), Powers(RUN)

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join([*texts, b""])
        whole = np.frombuffer(self.data, np.uint8)
        edges = np.diff(np.concatenate([[True], WHITE[whole], [True]]).astype(np.int8))
        self.begin, self.end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        bounds = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))])
        self.first = np.searchsorted(self.begin, bounds)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = np.empty(len(self.begin), np.uint64)
        at = 0
        while at < len(self.begin):  # in segments that end between words
            to = max(at + 1, int(np.searchsorted(self.end, self.begin[at] + SEGMENT, "right")))
            low, high = int(self.begin[at]), int(self.end[to - 1])
            up, down = self._bytes.get(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((whole[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
            self.hash[at:to] = mix((sums[self.end[at:to] - low] - sums[self.begin[at:to] - low]) * down[self.begin[at:to] - low])
            at = to

    def of(self, i: int) -> list[bytes]:
        """The words of text i."""
        a, b = self.first[i], self.first[i + 1]
        return self.data[self.begin[a] : self.end[b - 1]].split() if b > a else []

    def between(self, first: int, last: int) -> bytes:
        """The words from first to last, with one blank between."""
        return b" ".join(self.data[self.begin[first] : self.end[last]].split())

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; runs may go on into the next text."""
        size = max(0, len(self.hash) - n + 1)
        out = np.zeros(size, np.uint64)
        for j in range(n):
            out = out * np.uint64(GRAM) + self.hash[j : j + size]
        return mix(out)

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the words from each first to its last, independent of that of ``grams``."""
        up, down = self._runs.get(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum((self.hash ^ (self.hash >> np.uint64(29))) * up[: len(self.hash)], out=sums[1:])
        return mix((sums[last + 1] - sums[first]) * down[first] + (last - first + 1).astype(np.uint64))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out
