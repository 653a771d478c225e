"""Words and windows of words of many texts at once, in numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Words and windows get 64-bit
hashes by polynomials over the ring of 64-bit integers: sums of prefixes give every run of bytes or
words its value by one subtraction, and a finaliser spreads the bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = _POWERS[base] = (both[0], both[1])
    return have


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, salt: int = 0) -> np.ndarray:
    """A hash for each run values[starts:ends]."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + U(0x9E3779B97F4A7C15) * (ends - starts).astype(U), salt)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    at: np.ndarray  # where each text begins, and the end
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    first: np.ndarray  # the number of words before each text, and of all

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.n)

    def hashes(self, base: int = 0xD6E8FEB86659FD93, salt: int = 0) -> np.ndarray:
        return run_hashes(self.data, self.starts, self.ends, base, salt)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the text of each run of `size` words of one text."""
        per = np.maximum(self.n - size + 1, 0)
        text = np.repeat(np.arange(len(per)), per)
        skipped = np.concatenate([[0], np.cumsum(per)[:-1]]) if len(per) else np.zeros(0, np.int64)
        return np.arange(len(text)) - skipped[text] + self.first[:-1][text], text


def find_words(data: np.ndarray, at: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, at, none, none, np.zeros(len(at), np.int64))
    inside = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = at[at < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, at, starts, ends, np.searchsorted(starts, at))


def window_hashes(words: np.ndarray, first: np.ndarray, size: int, base: int = 0xA0761D6478BD642F, salt: int = 0) -> np.ndarray:
    return run_hashes(words, first, first + size, base, salt)


def covered(flags_at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of `size` that begins at one of flags_at."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, flags_at, 1)
    np.add.at(steps, np.minimum(flags_at + size, n), -1)
    return np.cumsum(steps[:-1]) > 0
