"""SimHash fingerprints and near-duplicate classes by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, slices, texts, unsigned_hex
from .graph import components

BITS = 64


def fingerprint(text: str, words: int = 4) -> int:
    """Signed 64-bit: a bit is 1 if set in over half of the XXH64 (seed 42) of the word shingles. No word: 0."""
    import xxhash

    # bytes.lower() changes A-Z only; bytes.split() splits at \x20 and \x09-\x0D only.
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n, buf, ends = max(1, len(w) - words + 1), b" ".join(w), np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(words, len(w)) - 1 :].tolist()
    total, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, 65_536):
        h = np.fromiter((digest(buf[i:j], 42) for i, j in zip(starts[k : k + 65_536], ends[k : k + 65_536])), "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def cheapest_segments(n: int, distance: int) -> int:
    """The number of segments that asks for the fewest look-ups and candidates a fingerprint among n of them, spread evenly."""

    def cost(segments: int) -> float:
        sizes = [BITS * (i + 1) // segments - BITS * i // segments for i in range(segments)]
        return sum(sum(comb(b, r) for r in range(distance // segments + 1)) * (1 + n / 2**b) for b in sizes)

    return min(range(1, distance + 2), key=cost)


def links(fps: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """Pairs a < b of the distinct fingerprints `fp` that differ in at most `distance` bits, each once.

    Of `segments` segments one differs in at most distance // segments bits, so each fingerprint looks up the
    Hamming ball of that radius round each of its segments. Of two that differ in a segment only the one with the
    greater value asks. The whole distance is a condition of the join, so near misses are never passed on.
    segments: by default as many as cost least for their number, fewer for more fingerprints; the links are the same.
    """
    segments = segments or cheapest_segments(fps.count(), distance)
    radius, cuts = distance // segments, [BITS * i // segments for i in range(segments + 1)]
    held, asked = [], []
    for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        key = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(hi - lo), r)]
        held.append(fps.select(F.lit(s).alias("s"), key.alias("key"), F.col("fp").alias("b")))
        asked.append(fps.select(F.lit(s).alias("s"), key.alias("own"), F.col("fp").alias("a"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).withColumn("key", F.col("own").bitwiseXOR(F.col("mask"))).where("key <= own").select("s", "key", "own", "a"))
    while len(held) > 1:
        held, asked = [held[0].unionByName(held[1]), *held[2:]], [asked[0].unionByName(asked[1]), *asked[2:]]
    p, q = asked[0].alias("p"), held[0].alias("q")
    near = (F.col("p.s") == F.col("q.s")) & (F.col("p.key") == F.col("q.key")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & ((F.col("p.key") < F.col("own")) | (F.col("a") < F.col("b")))
    # Spark takes the look-ups for as small as the fingerprints' file and would broadcast them all from the driver: joined by a shuffle.
    return p.join(q.hint("merge"), near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_components(fps: DataFrame, distance: int = 4, segments: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The links of distinct fingerprints, and (node, root) of those that have one."""
    pairs, _ = save(links(fps, distance, segments))
    return pairs, components(pairs)


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, segments: int | None = None) -> DataFrame:
    """One row a document: doc_id, fp, component_id (the smallest doc_id reachable over links), n_links (other fingerprints linked to its own).

    Equal fingerprints are linked without pairs: everything after the scan works on distinct ones.
    Defined cases: null or empty text: fingerprint 0; repeated doc_id: each row is returned; null doc_id: never the
    smallest unless alone; empty table: no rows; other columns are ignored.
    """
    fps, _ = save(fingerprints(docs, words))
    distinct, _ = save(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    pairs, root = link_components(distinct.select("fp"), distance, segments)
    degree = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    # What has a row for each fingerprint is joined by shuffles: the driver would hold several times the size of its file to broadcast it.
    linked = distinct.join(root.withColumnRenamed("node", "fp").hint("merge"), "fp").join(degree.hint("merge"), "fp")
    classes = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(classes, "root").select("fp", "component_id", "n_links")
    by_fp = distinct.join(linked.hint("merge"), "fp", "left").select("fp", "rows", F.when(F.col("n_links").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    by_fp, _ = save(by_fp)
    # A fingerprint of many rows would meet in one task. Those with a 500th of all rows are 500 at most, so they are broadcast.
    many = F.col("rows") * 500 >= F.lit(by_fp.agg(F.sum("rows")).first()[0] or 0)
    hot = F.broadcast(by_fp.where(many).drop("rows"))
    out = fps.join(hot, "fp").unionByName(fps.join(hot.select("fp"), "fp", "left_anti").join(by_fp.where(~many).drop("rows").hint("merge"), "fp"))
    return out.select("doc_id", "fp", "component_id", "n_links")


def representatives(docs: DataFrame, distance: int = 4, words: int = 4, segments: int | None = None) -> DataFrame:
    """One row of docs, all columns, of each class of near_duplicates: that of smallest doc_id (null last), then of smallest text hash.

    Rows are judged by their own text, not by doc_id: those with null or repeated ids stay if no other row of their class does.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    fps = texts(docs).select("doc_id", "text", text_hash.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())], names=["doc_id", "h", "fp"])

    fps, _ = save(fps.mapInArrow(run, "doc_id bigint, h bigint, fp bigint"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n")).alias("first")
    # The first row of each fingerprint, with the number of rows of that doc_id and text.
    by_fp, _ = save(fps.groupBy("fp", "doc_id", "h").agg(F.count("*").alias("n")).groupBy("fp").agg(first))
    _, root = link_components(by_fp.select("fp"), distance, segments)
    by_root = by_fp.join(root.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept, _ = save(by_root.select(F.col("first.doc_id").alias("_kept_id"), F.col("first.h").alias("_kept_h"), F.col("first.n").alias("_n")))

    def rows(kept: DataFrame) -> DataFrame:
        own = docs.withColumns({"_own_id": F.col("doc_id").cast("long"), "_own_h": text_hash})
        return own.join(kept.drop("_n").hint("merge"), F.col("_own_id").eqNullSafe(F.col("_kept_id")) & (F.col("_own_h") == F.col("_kept_h")), "left_semi")

    # Only rows that share doc_id and text are compared.
    out, again = rows(kept.where("_n = 1")), kept.where("_n > 1")
    if not again.isEmpty():
        out = out.unionByName(rows(again).dropDuplicates(["_own_id", "_own_h"]))
    return out.drop("_own_id", "_own_h")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id", "n_links")
