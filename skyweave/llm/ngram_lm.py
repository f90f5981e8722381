"""Language-model scores from an Elias-Fano n-gram trie.

The model has order three, over lower-cased words and one end a document, each order smoothed by the one below it as a prior:
P(w | a b) = (c(a b w) + k3 P(w | b)) / (c(a b) + k3), P(w | b) = (c(b w) + k2 P(w)) / (c(b) + k2), P(w) = (c(w) + 1) / (N + V + 1).
Its counts cover all training documents and grow with them, so no worker could hold them: each block of documents gets, by the
exchange of sorted records, the corpus-wide counts of the n-grams that it holds, builds their trie and queries it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, save, table
from .exchange import FANOUT, SENT, Block, Ranges, Records, answered, block_table, each, hashes, received, spread, squeeze, with_answers
from .repeats import mix
from .trie import Trie, restore

#: Stands for the end of a document; no word has white space.
END = b"\n"
FOLDS, HELD_OUT = 7, 2
WORD, PAIR, TRIPLE = 0, 1, 2


def held_out(doc_id: int | None) -> bool | None:
    """crc32 of doc_id as text, modulo 7, is 2. Null: None, which is neither scored as held out nor learned from."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and where each value stands among them, in 32 bits; only the distinct ones are sorted."""
    codes, values = pd.factorize(a)
    order = np.argsort(values)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return values[order], place[codes]


class Grams:
    """The distinct n-grams of a block: (parent, word) sorted, the place of each token's, a hash of each, and the order of the hashes."""

    def __init__(self, parent: np.ndarray, parent_hash: np.ndarray, word: np.ndarray, word_hash: np.ndarray):
        found, self.of = _distinct(parent.astype(np.int64) * len(word_hash) + word)
        self.parent, self.word = (found // len(word_hash)).astype(np.int32), (found % len(word_hash)).astype(np.int32)
        self.hash = mix(parent_hash[self.parent] * np.uint64(0x9E3779B97F4A7C15) + mix(word_hash[self.word]))
        self.order = np.argsort(self.hash).astype(np.int32)

    def records(self, counts: np.ndarray, some: np.ndarray | None = None) -> Records:
        order = self.order if some is None else self.order[some[self.order]]
        return Records(self.hash[order], counts[order])

    def received(self, answers: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """Answers to records(counts, some), by n-gram; 0 for the others."""
        out = np.zeros(len(self.hash), answers.dtype)
        out[self.order if some is None else self.order[some[self.order]]] = answers
        return out


class Tokens:
    """A block's tokens: words numbered by sorted hash, with an end after each document; its distinct bigrams, and its distinct trigrams,
    which begin with the second token of a document (the first has an end before it and nothing else)."""

    def __init__(self, b: Block):
        self.ids, self.sizes = b.doc_ids, np.diff(b.ends, prepend=0) + 1
        self.vocab, number = _distinct(np.concatenate([b.vocab, hashes([END])]))
        self.word = np.insert(number[b.codes], b.ends, number[-1])
        before = np.concatenate([number[-1:], self.word[:-1]])
        self.held = [held_out(d) for d in self.ids]
        self.train = np.repeat(np.array([h is False for h in self.held], bool), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.later = np.ones(len(self.word), bool)
        self.later[self.starts] = False
        self.pairs = Grams(before, self.vocab, self.word, self.vocab)
        at = np.flatnonzero(self.later)
        self.triples = Grams(self.pairs.of[at - 1], self.pairs.hash, self.word[at], self.vocab)

    def counts(self, kind: int) -> np.ndarray:
        """How often each word, bigram or trigram occurs in training documents here."""
        of, train, n = {WORD: lambda: (self.word, self.train, len(self.vocab)), PAIR: lambda: (self.pairs.of, self.train, len(self.pairs.hash)), TRIPLE: lambda: (self.triples.of, self.train[self.later], len(self.triples.hash))}[kind]()
        return np.bincount(of[train], minlength=n)

    def shared(self, pairs: np.ndarray) -> np.ndarray:
        """The trigrams that other blocks may hold too: both their bigrams are in others. Counts of the rest are those here."""
        elsewhere = self.pairs.received(pairs) & np.uint64(1) == 1
        at = np.flatnonzero(self.later)
        second = np.zeros(len(self.triples.hash), np.int32)
        second[self.triples.of] = self.pairs.of[at]
        return elsewhere[self.triples.parent] & elsewhere[second]


def _solve(kind: int, r: Records) -> tuple[np.ndarray, bytes | None]:
    """Twice the count over all blocks, and 1 more if other blocks hold it. Words: also their tokens and how many of them were learned."""
    summary = squeeze(np.array([r.counts.sum(), (r.counts > 0).sum()], "<u8")) if kind == WORD else None
    return 2 * r.counts + (r.senders > 1), summary


def _in_parts(fn, n: int, size: int = 250_000) -> list[np.ndarray]:
    """fn's arrays over slices of 0 .. n, joined."""
    return [np.concatenate(x) for x in zip(*(fn(slice(k, k + size)) for k in range(0, max(n, 1), size)))]


def score(docs: DataFrame, *, prior: tuple[float, float] = (1000.0, 10.0), block_bytes: int = 8 << 20, fanout: int = FANOUT) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), over whole texts.

    prior: k2 and k3. Null and empty texts: the end alone. Repeated doc_ids: each row is scored, and counted. Null doc_id: scored, not
    learned from, held_out null. Empty table: no rows. Without training documents every P is 1 / (V + 1) with V = 0.
    To score other texts, give them with the corpus and without doc_ids that are learned from.
    """
    spark = docs.sparkSession
    blocks = block_table(docs, block_bytes)
    ranges = Ranges.of(blocks, fanout)

    def short(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        t = Tokens(b)
        yield ranges.sent(WORD, b.number, Records(t.vocab, t.counts(WORD)))
        yield ranges.sent(PAIR, b.number, t.pairs.records(t.counts(PAIR)))

    def long(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        t = Tokens(b)
        yield ranges.sent(TRIPLE, b.number, t.triples.records(t.counts(TRIPLE), t.shared(received(row, PAIR, "<u8"))))

    first, _ = save(answered(blocks.mapInArrow(each(short), SENT), ranges, _solve, "<u8"), compression="none")
    release(spark)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2, np.int64)
        for b in batches:
            for x in b.column(0):
                n += spread(x.as_py(), "<u8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(n[:1]), pa.array(n[1:])], names=["n", "v"])

    whole = first.where("sender IS NULL").select("answer").mapInArrow(sums, "n bigint, v bigint").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = whole.n or 0, whole.v or 0
    second, _ = save(answered(with_answers(blocks, first.where(F.col("kind") == PAIR)).mapInArrow(each(long), SENT), ranges, _solve, "<u8"), compression="none")
    release(spark)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def scores(b: Block, row: dict) -> Iterator[pa.RecordBatch]:
        t, (k2, k3) = Tokens(b), prior
        count = lambda a: (a >> np.uint64(1)).astype(np.float64)
        pairs, some = received(row, PAIR, "<u8"), t.shared(received(row, PAIR, "<u8"))
        c1, c2 = count(received(row, WORD, "<u8")), count(t.pairs.received(pairs))
        c3 = np.where(some, count(t.triples.received(received(row, TRIPLE, "<u8"), some)), t.counts(TRIPLE))
        p1 = (c1 + 1) / (total + distinct + 1)
        p2 = (c2 + k2 * p1[t.pairs.word]) / (c1[t.pairs.parent] + k2)
        second = np.zeros(len(c3), np.int32)
        at = np.flatnonzero(t.later)
        second[t.triples.of] = t.pairs.of[at]
        p3 = (c3 + k3 * p2[second]) / (c2[t.triples.parent] + k3)
        # Only n-grams that were learned are in the trie; others back off.
        two, three = np.flatnonzero(c2 > 0), np.flatnonzero(c3 > 0)
        place = np.cumsum(c2 > 0) - 1
        trie = Trie(np.log10(p1), np.log10(k2 / (c1 + k2)), (t.pairs.parent[two], t.pairs.word[two].astype(np.int64), np.log10(p2[two]), np.log10(k3 / (c2[two] + k3))), (place[t.triples.parent[three]], t.triples.word[three].astype(np.int64), np.log10(p3[three]), np.zeros(0)))
        by_pair, found_pair = _in_parts(lambda k: trie.log10(0, t.pairs.parent[k].astype(np.int64), t.pairs.word[k].astype(np.int64), restore(trie.unigram[t.pairs.word[k]])), len(c2))
        by_triple, _ = _in_parts(lambda k: trie.log10(1, found_pair[t.triples.parent[k]], t.triples.word[k].astype(np.int64), by_pair[second[k]]), len(c3))
        found = np.empty(len(t.word))
        found[at] = by_triple[t.triples.of]
        found[t.starts] = by_pair[t.pairs.of[t.starts]]
        over, n = lambda x: np.add.reduceat(x, t.starts), len(t.ids)
        yield pa.RecordBatch.from_arrays([pa.array(t.ids, pa.int64()), pa.array(t.held, pa.bool_()), pa.array(t.sizes), pa.array(over((c1 > 0)[t.word].astype(np.int64))), pa.array([total] * n, pa.int64()), pa.array(over(np.log10(p1)[t.word])), pa.array(over(found))], names=[x.split()[0] for x in schema.split(", ")])

    return with_answers(blocks, first.unionByName(second)).mapInArrow(each(scores), schema)


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumn("held_out", F.coalesce("held_out", F.lit(False)))
