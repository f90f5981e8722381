"""Language identification by segmentation-marginalised unigrams.

Every language has its own probabilities of the pieces of one fixed public vocabulary. A word's
likelihood is the sum over all its segmentations into pieces, by a forward algorithm; pieces do not
span words, so a text's likelihood is the product over its words, and each distinct word is scored once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, slices, table

_RUN = re.compile(r"[^\W\d_]+")
START = "▁"
#: Sums below may have lost what lies out of a double's range; such words are scored with scales.
LEAST_SUM = 1e-250
#: Words up to this length are scored in groups; longer ones with scaling, one at a time.
GROUPED = 40
#: Words that a worker remembers at most, some 150 bytes and 8 a language each.
REMEMBERED_WORDS = 400_000


def words_of(text: str) -> list[str]:
    """The runs of letters (Unicode's L classes) of a text, in lower case; numerals such as one half or a Roman eight are no letters."""
    found = _RUN.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else (w,))]


def vocabulary(path: str) -> dict[str, int]:
    """The lower-case pieces of a sentencepiece model that hold letters only, after an optional word start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    kept = sorted({p for p in pieces if p == START or (p.lower() == p and p.removeprefix(START).isalpha())})
    return {p: i for i, p in enumerate(kept)}


class Lattice:
    """The segmentations of words into pieces of a vocabulary. A single character that is no piece counts as the unknown piece, the last id."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab, self.unknown, self.longest = vocab, len(vocab), max(map(len, vocab), default=1)

    def ids(self, words: list[str]) -> np.ndarray:
        """For words of one length n (with START): ids[word, end - 1, k] of the piece of k + 1 characters that ends there; len(vocab) + 1: none."""
        n = len(words[0])
        k = min(n, self.longest)
        out, get, none = np.full((len(words), n, k), self.unknown + 1, np.int32), self.vocab.get, self.unknown + 1
        spans = [(j - m, j) for j in range(1, n + 1) for m in range(1, min(j, k) + 1)]
        ends, sizes = np.array([(b - 1, b - a - 1) for a, b in spans]).T
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            out[i : i + 20_000, ends, sizes] = np.array([get(w[a:b], none) for w in some for a, b in spans], np.int32).reshape(len(some), -1)
        first = out[:, :, 0]
        first[first == none] = self.unknown
        return out

    @staticmethod
    def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]: summed probability of the segmentations of what lies before position. p[piece, language], its last row zero."""
        m, n, k = ids.shape
        alpha = np.zeros((m, n + 1, p.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, n + 1):
            for x in range(1, min(j, k) + 1):
                alpha[:, j] += alpha[:, j - x] * p[ids[:, j - 1, x - 1]]
        return alpha

    def log_likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of the summed probability, per word and language."""
        out, by = np.zeros((len(words), p.shape[1])), {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, at in by.items():
            for k in range(0, len(at), 20_000):
                some = at[k : k + 20_000]
                if n <= GROUPED:
                    total = self.forward(self.ids([words[i] for i in some]), p)[:, n]
                    low = (total < LEAST_SUM).any(1)
                    out[some] = np.log(np.where(low[:, None], 1.0, total))
                    for i in np.array(some)[low].tolist():
                        out[i] = self._long(words[i], p)
                else:
                    for i in some:
                        out[i] = self._long(words[i], p)
        return out

    def _long(self, word: str, p: np.ndarray) -> np.ndarray:
        """The same with the last alphas rescaled at each step, so that any length stays in range."""
        alphas, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
        for j in range(1, len(word) + 1):
            now = np.zeros(p.shape[1])
            for x in range(1, min(len(alphas), self.longest) + 1):
                i = self.vocab.get(word[j - x : j], self.unknown if x == 1 else -1)
                if i >= 0:
                    now += alphas[-x] * p[i]
            alphas = [a / now for a in alphas[-self.longest + 1 :]] + [np.ones(p.shape[1])]
            scale += np.log(now)
        return scale


def fit_pieces(lattice: Lattice, words: list[str], counts: np.ndarray, rounds: int = 3, prior: float = 0.5) -> np.ndarray:
    """Expectation maximisation of the piece probabilities, from counts[word, language]. Returns p[piece, language] with a last row of zeros."""
    size, langs = lattice.unknown + 1, counts.shape[1]
    p = np.vstack([np.full((size, langs), 1 / size), np.zeros((1, langs))])
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) <= GROUPED:
            by.setdefault(len(w), []).append(i)
    groups = [(lattice.ids([words[i] for i in at]), counts[at]) for at in by.values()]
    for _ in range(rounds):
        seen = np.zeros((size + 1, langs))
        for ids, c in groups:
            m, n, k = ids.shape
            alpha = lattice.forward(ids, p)
            beta = np.zeros_like(alpha)
            beta[:, n] = c / np.maximum(alpha[:, n], 1e-300)
            for j in range(n, 0, -1):
                for x in range(1, min(j, k) + 1):
                    piece = ids[:, j - 1, x - 1]
                    flow = p[piece] * beta[:, j]
                    for lang in range(langs):
                        seen[:, lang] += np.bincount(piece, flow[:, lang] * alpha[:, j - x, lang], size + 1)
                    beta[:, j - x] += flow
        seen = seen[:-1] + prior / 10
        p = np.vstack([seen / seen.sum(0), np.zeros((1, langs))])
    return p


def learnable(doc_id: Column) -> Column:
    """Rows to learn from: crc32 of doc_id as text, modulo 5, is not 0. Null doc_id: not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(labelled: DataFrame, vocab_path: str, *, sample_docs: int = 400) -> tuple[list[str], np.ndarray]:
    """Learn from the whole texts of at most sample_docs rows a language, those of smallest hash of doc_id. Rows: doc_id, text, lang.
    A word of over GROUPED - 1 letters is learned from in stretches of so many."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    lattice = Lattice(vocabulary(vocab_path))
    if not langs:
        return [], np.zeros((lattice.unknown + 2, 0))
    # Keep about thrice the sample by a threshold on the hash, then the smallest; so no language's rows meet in one task.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 3 * sample_docs / n + 1e-3)))])
    h = F.xxhash64("doc_id", F.lit("sample"))
    near = rows.where(F.pmod(h, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", F.xxhash64("text")))
    sample = near.withColumn("k", rank).where(F.col("k") <= sample_docs).drop("k")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                for w in words_of(t):
                    for x in (w,) if len(w) < GROUPED else (w[i : i + GROUPED - 1] for i in range(0, len(w), GROUPED - 1)):
                        seen[lang, x] = seen.get((lang, x), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    found = sample.mapInArrow(words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(found.word))
    at = {w: i for i, w in enumerate(names)}
    c = np.zeros((len(names), len(langs)))
    np.add.at(c, (found.word.map(at).to_numpy(int), found.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(int)), found.n.to_numpy(float))
    return langs, fit_pieces(lattice, [START + w for w in names], c)


class Predictor:
    """Predicts with one model; it remembers words between tasks."""

    def __init__(self, vocab_path: str, langs: list[str], p: np.ndarray):
        self.langs, self.p, self.lattice = langs, p, Lattice(vocabulary(vocab_path))
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [words_of(t) if t else [] for t in texts]
        if len(self.at) > REMEMBERED_WORDS:
            self.forget()
        new = sorted(set().union(*words) - self.at.keys()) if words and self.langs else []
        if new:
            first = len(self.at)
            if first + len(new) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros((first + 2 * len(new) - len(self.rows), len(self.langs)))])
            self.rows[first : first + len(new)] = self.lattice.log_likelihood([START + w for w in new], self.p)
            self.at.update(zip(new, range(first, first + len(new))))
        out = []
        for ws in words:
            if not ws or not self.langs:
                out.append(("und", 0.0))
                continue
            total = np.zeros(len(self.langs))
            for k in range(0, len(ws), 100_000):
                total += self.rows[np.fromiter(map(self.at.__getitem__, ws[k : k + 100_000]), np.int64)].sum(0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab_path: str, least_score: float | None = None) -> DataFrame:
    """doc_id, lang_pred, score: the likeliest language of each whole text and its posterior probability under equal priors.

    `und` with score 0 where a text is null or has no letter, or nothing was learned. With least_score, instead the rows
    of docs, all columns, whose language is found with that score at least. Null or repeated doc_ids: each row is returned.
    Ties: the first language by name. Empty table: no rows.
    """
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((vocab_path, *model))  # languages x 32,000 numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(key, lambda: Predictor(*shared.value))
        for part in slices(batches):
            found = own.predict(part.column("text").to_pylist())
            if least_score is not None:
                yield part.filter(pa.array([x != "und" and s >= least_score for x, s in found], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    if least_score is not None:
        return docs.mapInArrow(run, docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    out = predict(docs, fit(docs.where(learnable(F.col("doc_id"))), path), path)
    # A null doc_id is neither learned from nor held out.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
