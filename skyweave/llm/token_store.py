"""Token-ID output: each document's ids as one zstandard frame with a shared dictionary.

A store is a folder with two Parquet tables, so that it lies in any file system Spark reaches:

* dictionary: (dict_hash, dictionary, tokenizer, end_id), one row
* blocks: (part, block, first_doc, last_doc, start, doc_ids, n_tokens, offsets, payload, dict_hash)

A block's payload is the concatenation of its documents' frames; offsets[i]:offsets[i + 1] is the frame
of doc_ids[i], so one short document is read by decompressing its own frame only. Ids are stored as
little-endian unsigned 16-bit integers where the vocabulary allows it, else 32-bit. Blocks hold
consecutive documents in ascending doc_id order; `start` counts the ids before a block in its part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WordEncoder, chunks
from .common import partitions, slices, smallest_hashes, texts, workdir

BLOCK = "part int, block int, first_doc bigint, last_doc bigint, start bigint, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, payload binary, dict_hash string"
DICTIONARY = "dict_hash string, dictionary binary, tokenizer string, end_id bigint, width int"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, *, sample_docs: int = 400, sample_ids: int = 8192, dict_bytes: int = 65_536) -> tuple[bytes, int]:
    """A zstandard dictionary trained on the id arrays of a bounded sample: of the sample_docs documents of smallest hash, sample_ids ids
    each at most, from a place in the whole text that a hash tells.

    It only affects size, never content. Returns (dictionary, id width in bytes). Too little text: an empty dictionary.
    """
    import zstandard

    width = 2 if max(WordEncoder.of(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 65_536 else 4

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder.of(tokenizer)
        for b in slices(batches, 50):
            out = []
            for x in enc.encode(b.column(0).to_pylist()):
                a = np.frombuffer(x, "<u4").astype(f"<u{width}")
                at = zlib.crc32(x) % max(1, len(a) - sample_ids + 1)
                out.append(a[at : at + sample_ids].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    rows = smallest_hashes(texts(docs), sample_docs, "dictionary").select("text").mapInArrow(ids, "ids binary").collect()
    samples = sorted(bytes(r.ids) for r in rows if len(r.ids) >= 16)
    try:
        return (zstandard.train_dictionary(dict_bytes, samples).as_bytes() if len(samples) >= 32 else b""), width
    except zstandard.ZstdError:
        return b"", width


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 2, block_docs: int = 256, block_bytes: int = 1 << 20) -> None:
    """Encode every whole text (null: empty), append end_id, and write a store to `path` in ascending doc_id order.

    Defined cases: empty table: a store without blocks; null doc_id: first; repeated doc_ids: each row is kept,
    in the order of their texts' hashes; other columns are ignored. Texts are moved once, by ranges of doc_id.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    dictionary, width = train_dictionary(docs, tokenizer, end_id)
    key = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(key, bytearray(dictionary), tokenizer, end_id, width)], DICTIONARY).write.mode("overwrite").parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, comp, end = WordEncoder.of(tokenizer), _compressor(dictionary), np.array([end_id], f"<u{width}").tobytes()
        part, block, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal block, start, held, size
            n, frames = [x[1] for x in held], [x[2] for x in held]
            ids = [x[0] for x in held]
            # Null ids come first and are in no range.
            row = (part, block, next((d for d in ids if d is not None), None), ids[-1], start, ids, n, [0, *accumulate(map(len, frames))], b"".join(frames), key)
            block, start, held, size = block + 1, start + sum(n), [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _types)], names=_names)

        for b in slices(batches):
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for some in chunks(rows, lambda r: len(r[1])):
                for (d, _), ids in zip(some, enc.encode([t for _, t in some])):
                    if width == 2:
                        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                    frame = comp.compress(ids + end)
                    held.append((d, len(ids) // width + 1, frame))
                    size += len(frame)
                    if len(held) >= block_docs or size >= block_bytes:
                        yield out()
        if held:
            yield out()

    t = texts(docs)
    n = max(partitions(spark), t.rdd.getNumPartitions())
    t.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(encode, BLOCK).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")


_names = [x.split()[0] for x in BLOCK.split(", ")]
_types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string()]


def _dictionary(spark: SparkSession, path: str):
    return spark.read.schema(DICTIONARY).parquet(f"{path}/dictionary").first()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian u32)."""
    d = _dictionary(spark, path)
    key, dictionary, width = d.dict_hash, bytes(d.dictionary), d.width
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # One number for each written part: as many rows as tasks wrote it.
    parts = sorted(blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    before = dict(zip([r.part for r in parts], accumulate([r.n for r in parts], initial=0)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _decompressor(dictionary)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != key:
                    raise ValueError(f"block {r['part']}/{r['block']} needs dictionary {r['dict_hash']}")
                raw = [dec.decompress(r["payload"][i:j]) for i, j in zip(r["offsets"], r["offsets"][1:])]
                start = np.cumsum([before[r["part"]] + r["start"], *r["n_tokens"]])[:-1]
                ids = raw if width == 4 else [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in raw]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(r["n_tokens"], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("part", "block", "start", "doc_ids", "n_tokens", "offsets", "payload", "dict_hash").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the rows with this doc_id: block statistics prune the files, the offset index finds the frame, nothing else is decompressed."""
    d = _dictionary(spark, path)
    dec, out = _decompressor(bytes(d.dictionary)), []
    hit = spark.read.schema(BLOCK).parquet(f"{path}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    at = F.expr(f"filter(sequence(0, size(doc_ids) - 1), i -> doc_ids[i] = {int(doc_id)}L)")
    hit = hit.select("part", "block", "offsets", "payload", F.explode(at).alias("i")).select("part", "block", "i", F.expr("substring(payload, cast(offsets[i] as int) + 1, cast(offsets[i + 1] - offsets[i] as int))").alias("frame"))
    for r in hit.orderBy("part", "block", "i").collect():
        out.append(np.frombuffer(dec.decompress(bytes(r.frame)), f"<u{d.width}").tolist())
    return out


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = workdir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["op1_token_store", "read_document", "read_tokens", "train_dictionary", "write_tokens"]
