"""Repeated passages by a sparse suffix array.

Only suffixes at minimisers are kept: of each `window` consecutive k-grams the one of least hash, so that two copies of a passage of
min_words = k + window - 1 words keep a common suffix. They are sorted over all documents, at first by their first k words: a suffix
without an equal neighbour there is dropped. What is left is sorted by the words that follow, and by those that come before, read
backwards; the common prefixes of neighbours in either order tell how far a match extends to the right and to the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import release, save, table
from .exchange import FANOUT, SENT, Block, Ranges, Records, answered, block_table, each, received, with_answers

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SUFFIX, CONTEXT, STRETCH = 0, 1, 2
#: A context's answer: the left extensions that repeat, as bits, and the most copies of one of them.
FOUND = np.dtype([("bits", "<u8"), ("copies", "<u8")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64)[:n]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words, by a rolling polynomial modulo 2**64."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * _powers(_INVERSE, len(h) - n + 1))


def minimisers(g: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """Positions of the least hash (the first, if equal) of the `window` consecutive ones from each of `starts`."""
    out = [np.zeros(0, np.int64)]
    for k in range(0, len(starts), 1 << 16):
        some = starts[k : k + (1 << 16)]
        out.append(np.unique(some + np.lib.stride_tricks.sliding_window_view(g, window)[some].argmin(1)))
    return np.unique(np.concatenate(out))


def common_prefix(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group and then by their columns; and how many leading columns each shares with the one before it in that
    order, -1 where that is of another group."""
    order = np.lexsort((*rows.T[::-1], groups))
    a, g = rows[order], groups[order]
    same = np.cumprod(a[1:] == a[:-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return order, np.concatenate([[-1], np.where(g[1:] == g[:-1], same, -1)])


def extensions(groups: np.ndarray, after: np.ndarray, before: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """FOUND of suffixes of these groups (first k words), with the words after those and before them, nearest first.

    A suffix has a match that extends l words to the left if another of its group shares l words before and all but l of the words after;
    so many are neighbours in either order, with no smaller common prefix between them.
    """
    n, reach = after.shape
    out = np.zeros(n, FOUND)
    right, lcp = common_prefix(after, groups)
    left, lcs = common_prefix(before, groups)
    run = np.empty(n, np.int64)
    for way in range(reach + 1):
        run[right] = np.cumsum(lcp < reach - way)
        code = run * n
        run[left] = np.cumsum(lcs < way)
        which = pd.factorize(code + run)[0]
        copies = np.bincount(which, counts).astype(np.uint64)[which]
        # A document that ends before the stretch does has 0 for a word there.
        copies[(copies < 2) | (before[:, way - 1] == 0 if way else False) | (after[:, reach - way - 1] == 0 if way < reach else False)] = 0
        out["bits"] |= np.where(copies > 0, np.uint64(1 << way), np.uint64(0))
        out["copies"] = np.maximum(out["copies"], copies)
    return out


def repeated_spans(docs: DataFrame, *, min_words: int = 50, k: int = 25, block_bytes: int = 16 << 20, hot: int = 20_000, fanout: int = FANOUT) -> DataFrame:
    """doc_id, start_word, end_word, n_words, copies: the parts of whole texts covered by stretches of min_words words that occur
    more than once, in other documents or in the same; copies is the greatest number of occurrences of a stretch in the span.

    Null, empty or short texts: no span. Repeated or null doc_ids: each row counts as a document. Other columns are ignored.
    Hashes stand for the words compared: of 64 bits for the first k, of 32 for each word beyond. k < min_words < k + 64.
    A suffix whose first k words occur over `hot` times would bring as many contexts to one task; each stretch of min_words words that
    it may match in is sorted as a record of its own instead, which finds the same.
    """
    reach, window = min_words - k, min_words - k + 1
    blocks = block_table(docs, block_bytes)
    ranges = Ranges.of(blocks, fanout)

    class Suffixes:
        """A block's suffixes at minimisers, by position in its run of words; keys: the distinct hashes of their first k words."""

        def __init__(self, b: Block):
            self.h, self.ends = b.vocab[b.codes], b.ends
            self.sizes = np.diff(b.ends, prepend=0)
            self.doc = np.repeat(np.arange(len(b.ends)), self.sizes)
            self.first, self.last = (b.ends - self.sizes)[self.doc], b.ends[self.doc]  # of each word's document
            g = grams(self.h, k)
            self.at = minimisers(g, window, np.flatnonzero(np.arange(len(self.h)) + min_words <= self.last))
            self.keys, self.place, self.counts = np.unique(g[self.at], return_inverse=True, return_counts=True)
            self.g = g[self.at]

        def matched(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
            """Which suffixes have an equal neighbour and are not hot; which are hot."""
            n = received(row, SUFFIX, "<u8")[self.place] if len(self.at) else np.zeros(0, np.uint64)
            return (n > 1) & (n <= hot), n > hot

        def contexts(self, some: np.ndarray) -> tuple[Records, np.ndarray]:
            """The distinct contexts of some suffixes, sorted, and the place of each suffix's among them."""
            m = self.at[some]
            at = np.concatenate([m[:, None] + k + np.arange(reach), m[:, None] - 1 - np.arange(reach)], 1)
            there = (at < self.last[m][:, None]) & (at >= self.first[m][:, None])
            w = np.where(there, self.h[np.clip(at, 0, max(len(self.h) - 1, 0))].astype(np.uint32) | np.uint32(1), np.uint32(0)) if len(m) else np.zeros((0, 2 * reach), np.uint32)
            tie = self.g[some].copy()
            for c in w.T:
                tie = mix(tie * _BASE + c)
            tie, first, place, n = np.unique(tie, return_index=True, return_inverse=True, return_counts=True)
            r, order = Records(self.g[some][first], n, tie, w[first]).sorted()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return r, rank[place]

        def stretches(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Starts and hashes of the stretches of min_words words that hold the first k words of these suffixes."""
            marks = np.zeros(len(self.h) + 2, np.int64)
            m = self.at[some]
            np.add.at(marks, np.maximum(m - reach, self.first[m] if len(m) else 0), 1)
            np.add.at(marks, np.minimum(m, self.last[m] - min_words if len(m) else 0) + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks) > 0)
            return starts, grams(self.h, min_words)[starts] if len(starts) else np.zeros(0, np.uint64)

    def suffixes(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        s = Suffixes(b)
        yield ranges.sent(SUFFIX, b.number, Records(s.keys, s.counts))

    def contexts(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        s = Suffixes(b)
        some, frequent = s.matched(row)
        yield ranges.sent(CONTEXT, b.number, s.contexts(some)[0])
        yield ranges.sent(STRETCH, b.number, Records(*np.unique(s.stretches(frequent)[1], return_counts=True)))

    def solve(kind: int, r: Records) -> tuple[np.ndarray, None]:
        if kind == CONTEXT:
            return extensions(r.keys, r.extra[:, :reach], r.extra[:, reach:], r.counts), None
        return np.array([*zip(r.counts.tolist(), r.counts.tolist())], FOUND), None

    def spans(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        s, out = Suffixes(b), []
        some, frequent = s.matched(row)
        copies = np.zeros(len(s.h) + 1, np.uint64)
        m, found = s.at[some], received(row, CONTEXT, FOUND)[s.contexts(some)[1]]
        for way in range(reach + 1):
            hit = found["bits"] >> np.uint64(way) & np.uint64(1) == 1
            np.maximum.at(copies, m[hit] - way, found["copies"][hit])
        starts, x = s.stretches(frequent)
        times = received(row, STRETCH, FOUND)["copies"][np.searchsorted(np.unique(x), x)]
        np.maximum.at(copies, starts, np.where(times > 1, times, 0).astype(np.uint64))
        starts = np.flatnonzero(copies)
        cut = np.flatnonzero((np.diff(starts) > min_words) | (np.diff(s.doc[starts]) > 0)) + 1
        for x in np.split(starts, cut) if len(starts) else ():
            first, a, z = int(s.first[x[0]]), int(x[0]), int(x[-1]) + min_words
            out.append((b.doc_ids[s.doc[a]], a - first, z - first, z - a, int(copies[x].max())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start_word", "end_word", "n_words", "copies"])

    first, _ = save(answered(blocks.mapInArrow(each(suffixes), SENT), ranges, lambda _, r: (r.counts, None), "<u8"), compression="none")
    release(docs.sparkSession)
    second, _ = save(answered(with_answers(blocks, first).mapInArrow(each(contexts), SENT), ranges, solve, FOUND), compression="none")
    release(docs.sparkSession)
    return with_answers(blocks, first.unionByName(second)).mapInArrow(each(spans), "doc_id bigint, start_word bigint, end_word bigint, n_words bigint, copies bigint")


def remove_repeats(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans."""
    import re

    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, last = [], 0
    for a, b in sorted(spans):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:]


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
