"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each codebook, chosen by beam search. A query's product with
it is a sum of table look-ups, its norm is stored, and the best by these are ranked again by exact cosine.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, save, smallest_hashes, table, workdir


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centres; an empty one restarts at a point far from its own."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        far = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).astype(np.float64)
        own = far.argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-far[np.arange(len(x)), own])[: len(empty)]]
    return centres


class Additive:
    """Codebooks of shape (books, words, dimensions), and what encoding needs of them."""

    def __init__(self, codebooks: np.ndarray):
        self.codebooks = codebooks
        self.norms = (codebooks**2).sum(2)

    @classmethod
    def fit(cls, x: np.ndarray, books: int, words: int, *, rounds: int = 10, refits: int = 2, seed: int = 7) -> "Additive":
        """Residual k-means, then rounds of beam-search encoding and least squares for all codebooks together."""
        rng, residual, books_ = np.random.default_rng(seed), x.copy(), []
        for _ in range(books):
            c = kmeans(residual, min(words, len(x)), rounds, rng)
            c = np.vstack([c, np.zeros((words - len(c), x.shape[1]))])
            own = ((c**2).sum(1) - 2 * residual @ c.T).argmin(1)
            residual = residual - c[own]
            books_.append(c)
        out = cls(np.array(books_))
        for _ in range(refits):
            codes = out.encode(x)
            size = books * words
            at = codes + np.arange(books) * words
            gram, right = np.eye(size) * 0.1, np.zeros((size, x.shape[1]))
            for a in range(books):
                np.add.at(right, at[:, a], x)
                for b in range(books):
                    np.add.at(gram, (at[:, a], at[:, b]), 1.0)
            right += 0.1 * out.codebooks.reshape(size, -1)
            out = cls(np.linalg.solve(gram, right).reshape(books, words, -1))
        return out

    def encode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """codes[vector, book] by beam search: at each codebook the `beam` best partial sums are kept."""
        out = np.zeros((len(x), len(self.codebooks)), np.int64)
        for k in range(0, len(x), 2048):
            v = x[k : k + 2048]
            n, words = len(v), self.codebooks.shape[1]
            residual, cost = v[:, None, :], (v**2).sum(1)[:, None]
            codes = np.zeros((n, 1, 0), np.int64)
            for book, norms in zip(self.codebooks, self.norms):
                total = (cost[:, :, None] + norms - 2 * residual @ book.T).reshape(n, -1)
                b = min(beam, total.shape[1])
                best = np.argpartition(total, b - 1, axis=1)[:, :b]
                old, word = best // words, best % words
                rows = np.arange(n)[:, None]
                cost, residual = total[rows, best], residual[rows, old] - book[word]
                codes = np.concatenate([codes[rows, old], word[:, :, None]], 2)
            out[k : k + 2048] = codes[np.arange(n), cost.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum((book[codes[:, i]] for i, book in enumerate(self.codebooks)), np.zeros((len(codes), self.codebooks.shape[2])))

    def products(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The product of each query with each coded vector, by look-ups in its tables."""
        tables = np.einsum("qd,bwd->bqw", queries, self.codebooks).astype(np.float32)
        out = np.zeros((len(queries), len(codes)), np.float32)
        for i, t in enumerate(tables):
            out += t[:, codes[:, i]]
        return out


def _best(near: np.ndarray, n: int) -> np.ndarray:
    """The places of the n greatest of each row, the first of equal ones."""
    if near.shape[1] <= n:
        return np.broadcast_to(np.arange(near.shape[1]), near.shape)
    least = -np.partition(-near, n - 1, axis=1)[:, n - 1 : n]
    above, equal = near > least, near == least
    # As many of those at the limit, from the left, as the ones above it leave room for.
    keep = above | equal & (np.cumsum(equal, axis=1) <= n - above.sum(1, keepdims=True))
    return np.nonzero(keep)[1].reshape(len(near), n)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part: not null, not empty, no null or non-finite component, not zero."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where((F.size("vector") > 0) & F.coalesce(fine, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; first by their greatest component, so that no square leaves the range of doubles."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def build(vectors: DataFrame, *, books: int = 8, words: int = 128, sample_rows: int = 10_000) -> tuple[DataFrame, np.ndarray]:
    """Index every usable vector: (vec_id, vector, codes binary, norm of the coded vector), written; and the codebooks.

    The codebooks are fitted to at most sample_rows unit vectors, those of smallest hash of vec_id. All vectors of an index have one
    dimension, the sample's most common one (the lesser, if equal); those of another cannot be compared with them and take no part.
    """
    rows = usable(vectors)
    sample = smallest_hashes(rows, sample_rows, "sample", "vec_id").select("vector").toPandas()
    if not len(sample):
        return rows.select("vec_id", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm")), np.zeros((0, 0, 0))
    dimensions = int(sample.vector.map(len).mode()[0])
    rows = rows.where(F.size("vector") == dimensions)
    x = np.array([v for v in sample.vector if len(v) == dimensions], np.float64)
    codebooks = Additive.fit(unit(x), books, min(words, 256)).codebooks
    key, shared = uuid.uuid4().hex, vectors.sparkSession.sparkContext.broadcast(codebooks)  # books x words x dimensions

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(key, lambda: Additive(shared.value))
        for b in batches:
            v = _matrix(b.column("vector"))
            codes = model.encode(unit(v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(np.linalg.norm(model.decode(codes), axis=1))], names=["vec_id", "vector", "codes", "norm"])

    return save(rows.mapInArrow(encode, "vec_id bigint, vector array<double>, codes binary, norm double"))[0], codebooks


def search(index: DataFrame, codebooks: np.ndarray, queries: DataFrame, *, k: int = 5, rerank: int = 512, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine, ties to the smaller vec_id, its own vec_id left out.

    queries: vec_id, vector. They are taken in blocks of about `block` (by default 16 MB), each broadcast, met by every part of the index,
    written and released before the next; a part ranks exactly the `rerank` best by look-up of each chunk of its rows and passes on k a query.
    Repeated vec_ids are candidates each.
    """
    spark, path, books = index.sparkSession, workdir(index.sparkSession), index.sparkSession.sparkContext.broadcast(codebooks)
    key, schema, result = uuid.uuid4().hex, "query_id bigint, vec_id bigint, score double", "query_id bigint, rank int, vec_id bigint, score double"
    if not codebooks.size:
        return spark.createDataFrame([], result)
    ids = queries.select("vec_id", "vector")
    block = block or max(1, (16 << 20) // (8 * codebooks.shape[2]))
    blocks = max(1, -(-ids.count() // block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    for i in range(blocks):
        own = ids.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toPandas()  # about `block` rows
        q = unit(np.array(own.vector.tolist(), np.float64)) if len(own) else np.zeros((0, codebooks.shape[2]))
        shared = spark.sparkContext.broadcast((own.vec_id.to_numpy(np.int64), q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = kept(key, lambda: Additive(books.value))
            qid, q = shared.value
            best_id, best = np.full((len(qid), 0), 0, np.int64), np.full((len(qid), 0), 0.0)
            for b in batches:
                for at in range(0, len(b), 4096):
                    part = b.slice(at, 4096)
                    part = part.take(pa.compute.sort_indices(part.column("vec_id")))
                    vid, v = part.column("vec_id").to_numpy(), unit(_matrix(part.column("vector")))
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(part), -1)
                    norm = part.column("norm").to_numpy()
                    new_id, new = [], []
                    for j in range(0, len(qid), 128):
                        some = slice(j, j + 128)
                        near = model.products(q[some], codes) / np.maximum(norm, 1e-9).astype(np.float32)
                        near[qid[some, None] == vid] = -np.inf
                        top = _best(near, rerank)
                        exact = (q[some, None, :] * v[top]).sum(2)
                        exact[qid[some, None] == vid[top]] = -np.inf
                        order = np.lexsort((vid[top], -exact), axis=1)[:, :k]
                        new_id.append(np.take_along_axis(vid[top], order, 1))
                        new.append(np.take_along_axis(exact, order, 1))
                    if new:
                        best_id, best = np.hstack([best_id, np.vstack(new_id)]), np.hstack([best, np.vstack(new)])
                        order = np.lexsort((best_id, -best), axis=1)[:, :k]
                        best_id, best = np.take_along_axis(best_id, order, 1), np.take_along_axis(best, order, 1)
            ok = best > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], best.shape)[ok]), pa.array(best_id[ok]), pa.array(best[ok])], names=["query_id", "vec_id", "score"])

        index.mapInArrow(run, schema).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(result).parquet(path)


def op10_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, codebooks = build(table(spark, sf_dir, "embeddings"))
    return search(index, codebooks, index.where("vec_id % 50 = 0").select("vec_id", "vector"))
