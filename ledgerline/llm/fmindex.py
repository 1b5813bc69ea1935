"""A compressed FM-index over integer symbols: suffix order, wavelet matrix, backward search and locate.

Symbol 0 separates fragments. Every separator counts as a symbol of its own in the suffix order, so no
comparison runs past a fragment, and patterns never contain it. All searches advance many patterns at once.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, by prefix doubling over 64-bit keys.

    Separators (0) rank by position, so the number of rounds is the logarithm of the longest fragment.
    """
    n = len(text)
    seps = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(seps)
    key[seps] = np.arange(len(seps))
    if n:  # two symbols at once; a separator needs none behind it
        key = key << 32
        key[:-1] |= np.where(text[:-1] == 0, 0, key[1:] >> 32)
    order = np.argsort(key)
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    rank = np.empty(n, np.int64)  # the place of the first of equals
    rank[order] = np.repeat(begin, size)
    # Only what is still equal is sorted further, each group within its own places.
    step, places = 2, np.flatnonzero(np.repeat(size > 1, size))
    while len(places):
        live = order[places]
        group = rank[live]
        following = np.where(live + step < n, rank[np.minimum(live + step, n - 1)] + 1, 0)
        inner = np.argsort(group << 32 | following)
        live, group, following = live[inner], group[inner], following[inner]
        order[places] = live
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        fresh = np.flatnonzero(opens | np.concatenate([[True], following[1:] != following[:-1]]))
        first = np.flatnonzero(opens)
        base = np.repeat(first, np.diff(np.append(first, len(live))))
        size = np.diff(np.append(fresh, len(live)))
        rank[live] = group + np.repeat(fresh, size) - base
        places = places[np.repeat(size > 1, size)]
        step *= 2
    return order


class WaveletMatrix:
    """Symbols as one bit vector a level, with counts a word: rank and access in as many steps as levels."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        size = self.n // 64 + 1
        self.words = np.zeros((self.levels, size), np.uint64)
        self.before = np.zeros((self.levels, size), np.uint32)
        self.zeros = np.zeros(self.levels, np.int64)
        now = symbols.astype(np.uint32)
        for level in range(self.levels):
            bit = (now >> np.uint32(self.levels - 1 - level)) & np.uint32(1) == 1
            packed = np.zeros(size * 8, np.uint8)
            bits = np.packbits(bit, bitorder="little")
            packed[: len(bits)] = bits
            self.words[level] = packed.view(np.uint64)
            self.before[level, 1:] = np.cumsum(np.bitwise_count(self.words[level]))[:-1]
            self.zeros[level] = self.n - int(bit.sum())
            now = np.concatenate([now[~bit], now[bit]])
        self.begin = self._down(np.arange(sigma, dtype=np.uint32), np.zeros(sigma, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask).astype(np.int64)

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = (symbols >> np.uint32(self.levels - 1 - level)) & np.uint32(1) == 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbols, at) - self.begin[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbols = np.zeros(len(at), np.uint32)
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1
            symbols = (symbols << np.uint32(1)) | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return symbols, at - self.begin[symbols]


class FMIndex:
    """``text`` holds symbols below ``sigma``; ``sample`` is the distance of the sampled suffix positions (0: none)."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        self.n = len(text)
        order = suffix_order(text)
        last = text[order - 1] if self.n else text
        self.wavelet = WaveletMatrix(last, sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        if sample:  # every fragment's first position is sampled too: no walk crosses a separator
            held = (order % sample == 0) | (last == 0)
            self.held = held
            self.slot = np.cumsum(held) - 1
            self.position = order[held]
        self.order = order

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: intervals of the suffixes that begin with each symbol before the present match."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        first, n = self.below[symbols], len(symbols)
        return first + both[:n], first + both[n:]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the rows of a matrix of patterns of one length."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            low[live], high[live] = self.extend(patterns[live, k], low[live], high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk backwards to the next sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.held[rows[live]]
            at = live[done]
            out[at] = self.position[self.slot[rows[at]]] + steps[at]
            live = live[~done]
            if len(live):
                symbols, rank = self.wavelet.access(rows[live])
                rows[live] = self.below[symbols] + rank
                steps[live] += 1
        return out


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the given half-open ranges, and the range of each."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which], which
