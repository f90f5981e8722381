"""A compact n-gram trie in memory-mapped levels: Elias-Fano sequences and quantised log-probabilities."""

from __future__ import annotations

import tempfile

import numpy as np

#: Log10-probabilities are kept as multiples of 1 / STEP, from 0 down.
STEP = 4096

_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
_SELECT = np.full((256, 8), 8, np.int64)
for _byte in range(256):
    for _k, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _SELECT[_byte, _k] = _bit


def quantise(log10_p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10_p * STEP), 65_535).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return q / -STEP


class Mapped:
    """Arrays in one memory-mapped file of the task that made them. It has no name any more, so nothing is left behind when a worker is
    lost, and nobody else reads it."""

    def __init__(self):
        self.file, self.at = tempfile.TemporaryFile(), 0

    def put(self, a: np.ndarray) -> np.ndarray:
        a = np.ascontiguousarray(a)
        if not a.size:
            return a
        self.file.seek(self.at)
        self.file.write(a.tobytes())
        self.file.flush()
        out = np.memmap(self.file, a.dtype, "r", self.at, a.shape)
        self.at += -(-a.nbytes // 4096) * 4096
        return out


class EliasFano:
    """A sorted sequence of n numbers below `bound` in about 2 + log2(bound / n) bits each: the low bits plainly, the high ones in unary.

    The low bits are whole bytes (0, 1, 2 or 4), so that one look-up reads them.
    """

    def __init__(self, values: np.ndarray, bound: int, store: Mapped):
        n = self.n = len(values)
        best = max(0, int(bound // max(n, 1)).bit_length() - 1)
        self.low_bits = next(b for b in (0, 8, 16, 32) if b >= min(best, 32) - 3)
        high = (values >> self.low_bits).astype(np.int64)
        self.highs = int(bound >> self.low_bits) + 1
        bits = np.zeros(n + self.highs + 8, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        self.bytes = store.put(packed)
        self.zeros_before = store.put(np.concatenate([[0], np.cumsum(8 - _ONES[packed])]).astype(np.uint32 if len(bits) < 2**32 else np.uint64))
        self.ones_before = store.put(np.concatenate([[0], np.cumsum(_ONES[packed])]).astype(np.uint32 if len(bits) < 2**32 else np.uint64))
        kind = {0: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32}[self.low_bits]
        self.low = store.put((values & ((1 << self.low_bits) - 1)).astype(kind))

    def _select(self, before: np.ndarray, k: np.ndarray, flip: int) -> np.ndarray:
        """Position of the k-th (from 0) one, or zero with flip 255."""
        byte = np.searchsorted(before, k, "right") - 1
        return 8 * byte + _SELECT[self.bytes[byte] ^ np.uint8(flip), k - before[byte].astype(np.int64)]

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(self.ones_before, i, 0) - i) << self.low_bits) | self.low[i]

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value that is x or more, n where there is none; and whether that value is x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = np.minimum(x >> self.low_bits, self.highs)
        # Elements before the high-th zero have a lower high part; up to the next zero it is equal, and the low bits decide by bisection.
        lo = np.where(high > 0, self._select(self.zeros_before, np.maximum(high - 1, 0), 255) - high + 1, 0)
        hi = np.minimum(self._select(self.zeros_before, high, 255) - high, self.n)
        lo, low, end = np.minimum(lo, self.n), x & ((1 << self.low_bits) - 1), hi.copy()
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) // 2
            less = self.low[mid] < low[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
        same = lo < end
        same[same] = self.low[lo[same]] == low[same]
        return lo, same


class Level:
    """The n-grams of one order: the successors of each entry of the level above (its parents), all as one monotone Elias-Fano sequence
    in which a parent's successors are counted on from where the last parent's end; their log10-probabilities and back-off weights."""

    def __init__(self, parents: int, parent: np.ndarray, word: np.ndarray, log10_p: np.ndarray, backoff: np.ndarray, store: Mapped):
        """parent, word: the entries, sorted. backoff may be empty, for the last level."""
        starts = np.searchsorted(parent, np.arange(parents + 1))
        self.pointers = EliasFano(starts, len(parent) + 1, store)
        # A parent's successors begin past the greatest successor of the parent before it.
        last = np.zeros(parents, np.int64)
        full = starts[1:] > starts[:-1]
        last[full] = word[starts[1:][full] - 1] + 1
        base = np.concatenate([[0], np.cumsum(last)])
        self.bases = EliasFano(base, int(base[-1]) + 1, store)
        self.successors = EliasFano(base[parent] + word, int(base[-1]) + 1, store)
        self.p, self.backoff = store.put(quantise(log10_p)), store.put(quantise(backoff))

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each entry, -1 where there is none: by successor search within the parent's range."""
        out = np.full(len(parent), -1)
        if not len(parent):
            return out
        # Each parent's range is read once; sorted queries have equal parents together.
        new = np.concatenate([[True], parent[1:] != parent[:-1]])
        own, at = parent[new], np.cumsum(new) - 1
        lo, hi, base = (x[at] for x in (self.pointers.get(own), self.pointers.get(own + 1), self.bases.get(own)))
        some = np.flatnonzero(lo < hi)
        at, same = self.successors.successor(base[some] + word[some])
        # A word past the parent's last successor would be another parent's.
        same &= at < hi[some]
        out[some[same]] = at[same]
        return out


class Trie:
    """Levels over word numbers 0 .. words - 1. Level 1 has the log10-probability and back-off weight of each word; those below are Level's."""

    def __init__(self, unigram: np.ndarray, backoff: np.ndarray, *levels: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
        """unigram, backoff: log10, by word. levels: (parent, word, log10_p, backoff), sorted; a parent is a place in the level above."""
        store, parents = Mapped(), len(unigram)
        self.unigram, self.backoff, self.levels = store.put(quantise(unigram)), store.put(quantise(backoff)), []
        for level in levels:
            self.levels.append(Level(parents, *level, store))
            parents = len(level[0])

    def log10(self, level: int, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For n-grams of level + 2 words: log10 P(last word | words before it), by successor search in the context's range, else the
        context's back-off weight times `lower`; and the places found, -1 where there is none.

        context: the place of the words before in the level above (of words: their numbers), -1 if nowhere, which weighs nothing;
        lower: log10 P of the last word after one word less, as the level above gives it.
        """
        known = np.flatnonzero(context >= 0)
        own, above = self.levels[level], self.levels[level - 1].backoff if level else self.backoff
        place, out = np.full(len(context), -1), lower.copy()
        place[known] = at = own.find(context[known], word[known])
        out[known] += restore(above[context[known]])
        hit = at >= 0
        out[known[hit]] = restore(own.p[at[hit]])
        return out, place
