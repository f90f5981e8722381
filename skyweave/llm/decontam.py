"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are runs of letters and digits after lower-casing A-Z and dropping ASCII punctuation. An n-gram of a
test item is a seed if, from the counts of its words over all documents, chance alone would hardly ever make it;
so a passage copied into thousands of documents keeps its seeds. A seed in a document aligns the item with the
words round it. An item whose seeds a few edits can break is aligned with whole texts that share enough of its words.
Items are taken in blocks of a bounded number of words, each block broadcast; equal items are one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, slices, table, texts

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
MATCH, MISMATCH, GAP = 2, -1, -1
#: Lengths of seeds. Items whose seeds fewer edits than one in so many words can break are aligned with whole texts.
SEED_WORDS, WORDS_AN_EDIT = (2, 3, 4), 8


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best local score and the end of its alignment in the window. One vector step an item word."""
    n = len(window)
    ramp = np.arange(n + 1) * -GAP
    h, best, end = np.zeros(n + 1, np.int64), 0, 0
    for x in item:
        now = np.zeros(n + 1, np.int64)
        np.maximum(h[:-1] + np.where(window == x, MATCH, MISMATCH), h[1:] + GAP, out=now[1:])
        np.maximum(now, 0, out=now)
        # A gap along the window: the running maximum of what stands before it, less its length.
        h = np.maximum.accumulate(now + ramp) - ramp
        k = int(h.argmax())
        if h[k] > best:
            best, end = int(h[k]), k
    return best, end


class Block:
    """A block of items and its seeds; the same object serves all tasks of a worker."""

    def __init__(self, items: list[tuple[int, list[bytes]]], counts: dict[bytes, int], total: int, least_share: float, rare: float):
        self.least_share = least_share
        same: dict[tuple, list[int]] = {}
        for i, ws in items:
            same.setdefault(tuple(ws), []).append(i)
        self.ids = list(same.values())
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for ws in same for w in ws}))}
        self.coded = [np.array([self.vocab[w] for w in ws], np.int64) for ws in same]
        self.base = len(self.vocab) + 1
        log_p = np.zeros(self.base)
        for w, i in self.vocab.items():
            log_p[i] = np.log10((counts.get(w, 0) + 1) / (total + 1))
        # A seed's expected number of chance places is at most `rare` a million words. Of those that begin at a word the shortest serves.
        self.where: dict[int, dict[int, list[tuple[int, int]]]] = {n: {} for n in SEED_WORDS}
        apart = [0] * len(self.coded)
        for k, c in enumerate(self.coded):
            ends = []
            for j in range(len(c)):
                n = next((n for n in SEED_WORDS if j + n <= len(c) and log_p[c[j : j + n]].sum() + 6 <= np.log10(rare)), None)
                if n:
                    self.where[n].setdefault(self._key(c[j : j + n]), []).append((k, j))
                    ends.append((j + n, j))
            # As many edits as there are seeds without a word in common break them all; fewer leave one.
            last = 0
            for end, j in sorted(ends):
                if j >= last:
                    apart[k], last = apart[k] + 1, end
        self.whole = {k: np.unique(c, return_counts=True) for k, c in enumerate(self.coded) if apart[k] * WORDS_AN_EDIT < len(c)}
        for n, found in self.where.items():
            self.where[n] = {g: rest for g, at in found.items() if (rest := [x for x in at if x[0] not in self.whole])}
        self.keys = {n: np.array(sorted(found), np.int64) for n, found in self.where.items()}

    def _key(self, gram) -> int:
        out = 0
        for x in gram:
            out = (out * self.base + int(x)) & 0x7FFFFFFFFFFFFFFF
        return out

    def search(self, text: str) -> list[tuple[int, float, int, int, int]]:
        """(item_id, share, first word, end word, n_words) of the items that the whole text holds at least least_share of."""
        ws = words(text)
        c = np.fromiter(map(self.vocab.get, ws, [0] * len(ws)), np.int64, len(ws))
        known = c > 0
        if not known.any():
            return []
        places: dict[int, list[int]] = {}
        for n, keys in self.keys.items():
            if len(c) < n or not len(keys):
                continue
            ok = known[: len(c) - n + 1].copy()
            for j in range(1, n):
                ok &= known[j : len(c) - n + 1 + j]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            grams = np.zeros(len(at), np.int64)
            for j in range(n):
                grams = (grams * self.base + c[at + j]) & 0x7FFFFFFFFFFFFFFF
            k = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = keys[k] == grams
            for p, g in zip(at[hit].tolist(), grams[hit].tolist()):
                for item, j in self.where[n][g]:
                    places.setdefault(item, []).append(p - j)
        out = []
        held = np.bincount(c, minlength=self.base) if self.whole else None
        for item, (own, n) in self.whole.items():
            size = len(self.coded[item])
            # No alignment matches more words than item and text share.
            if np.minimum(held[own], n).sum() < self.least_share * size:
                continue
            score, end = align(self.coded[item], c)
            if score / (MATCH * size) >= self.least_share:
                out += [(i, score / (MATCH * size), max(0, end - size), end, size) for i in self.ids[item]]
        for item, at in places.items():
            own, best = self.coded[item], (0, 0, 0)
            pad, size = len(own) // 2 + 4, len(own)
            done = -1
            for p in sorted(set(at)):
                lo, hi = max(0, p - pad, done - 2 * size - 2 * pad), min(len(c), p + size + pad)
                if hi <= done:
                    continue  # an earlier window covers it
                score, end = align(own, c[lo:hi])
                done = hi
                if score > best[0]:
                    best = score, max(lo, lo + end - size), lo + end
            share = best[0] / (MATCH * size)
            if share >= self.least_share:
                out += [(i, share, best[1], best[2], size) for i in self.ids[item]]
        return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in blocks of about block_words words, read one partition after another; repeated texts are kept, empty ones dropped."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").toLocalIterator():
        ws = words(r.text)
        if ws:
            held.append((r.item_id, ws))
            size += len(ws)
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def _blocks(docs: DataFrame, benchmark: DataFrame, least_share: float, rare: float, block_words: int) -> Iterator[tuple]:
    for items in item_blocks(benchmark, block_words):
        vocab = docs.sparkSession.sparkContext.broadcast({w for _, ws in items for w in ws})

        def count(batches: Iterator[pa.RecordBatch], vocab=vocab) -> Iterator[pa.RecordBatch]:
            seen, total = dict.fromkeys(vocab.value, 0), 0
            for b in batches:
                for t in b.column(0):
                    ws = words(t.as_py())
                    total += len(ws)
                    for w in filter(seen.__contains__, ws):
                        seen[w] += 1
            seen = {w: n for w, n in seen.items() if n}
            yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([total, *seen.values()], pa.int64())], names=["word", "n"])

        counts = {bytes(r.word): r.n for r in texts(docs).select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        total = counts.pop(b"", 0)
        yield uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((items, counts, total, least_share, rare))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least_share: float = 0.5, rare: float = 0.05, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, share, first_word, end_word: whole documents that hold test items, exact or edited.

    share is the Smith-Waterman score (match 2, mismatch and gap -1) over the item's best possible; rows have least_share
    or more. A copy with fewer edits than one in eight of the item's words is always found, and of others those that keep one of
    the item's seeds; items with few seeds are compared with all texts at any number of edits. Null and empty texts and items give no row; null or repeated doc_ids and repeated items give a row each; very long texts are
    searched whole, round their seeds; other columns are ignored.
    """
    schema = "doc_id bigint, item_id bigint, share double, first_word bigint, end_word bigint, item_words bigint"
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    names, out = [x.split()[0] for x in schema.split(", ")], docs.sparkSession.createDataFrame([], schema)
    for key, shared in _blocks(docs, benchmark, least_share, rare, block_words):

        def run(batches: Iterator[pa.RecordBatch], key=key, shared=shared) -> Iterator[pa.RecordBatch]:
            block = kept(key, lambda: Block(*shared.value))
            for b in slices(batches):
                rows = [(d.as_py(), *hit) for d, t in zip(b.column(0), b.column(1)) for hit in block.search(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        out = out.unionByName(texts(docs).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, least_share: float = 0.5, rare: float = 0.05, block_words: int = 2_000_000) -> DataFrame:
    """The rows of docs, all columns, whose text holds no test item."""
    out, schema = docs, docs.schema
    for key, shared in _blocks(docs, benchmark, least_share, rare, block_words):

        def run(batches: Iterator[pa.RecordBatch], key=key, shared=shared) -> Iterator[pa.RecordBatch]:
            block = kept(key, lambda: Block(*shared.value))
            for b in slices(batches):
                yield b.filter(pa.array([not block.search(t) if t else True for t in b.column("text").to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
