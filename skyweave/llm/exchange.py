"""Blocks of documents, and what all blocks hold of a record returned to each block.

A block is one row that holds some megabytes of whole documents as numbered words. It sends its distinct records, sorted by a 64-bit
key, as one row for each range of keys; in a range equal neighbours are merged and solved, and each sender is answered in the order
of its own records. Spark thus moves a few large rows in place of one for each record, and no record meets more rows than there are
senders.

A block sends to at most `FANOUT` ranges, however many blocks there are. Where the corpus needs more ranges, the rows of a range are
dealt to teams of about as many senders; a team merges them, which makes about one block's worth of records, and sends these on to
the ranges within its own. So rows grow as the blocks times the levels, and the levels as the logarithm of the blocks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, save, texts, workdir

BLOCK = "block bigint, doc_ids binary, has_id binary, sizes binary, vocab binary, codes binary"
SENT = "kind int, bucket bigint, sender bigint, keys binary, ties binary, counts binary, senders binary, extra binary"
ANSWERED = "kind int, bucket bigint, sender bigint, answer binary"
#: The most ranges that one sender's records are cut into.
FANOUT = 512


def squeeze(a) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else a.tobytes())


def spread(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _planes(a: np.ndarray) -> bytes:
    """Numbers of one type, compressed with bytes of equal rank together: those of sorted keys, small codes or columns differ little."""
    return squeeze(np.ascontiguousarray(np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.itemsize).T))


def _numbers(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(spread(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


# blocks


def words(text: bytes) -> list[bytes]:
    """Words are what stands between \\x20 and \\x09-\\x0D, with A-Z lower-cased."""
    return text.lower().split()


def hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


@dataclass
class Block:
    """Documents as one run of words: document i has words ends[i - 1]:ends[i]; word j has the hash vocab[codes[j]]."""

    number: int
    doc_ids: list[int | None]
    ends: np.ndarray
    vocab: np.ndarray
    codes: np.ndarray

    @classmethod
    def opened(cls, row: dict) -> "Block":
        ids, has = spread(row["doc_ids"], "<i8").tolist(), spread(row["has_id"], bool).tolist()
        return cls(row["block"], [d if h else None for d, h in zip(ids, has)], np.cumsum(spread(row["sizes"], "<i8")), _numbers(row["vocab"], "<u8"), _numbers(row["codes"], "<u4").astype(np.int64))


def block_table(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The documents (null text: empty) as written blocks of about block_bytes of text each; one longer document is a block alone.

    The table is bucketed by block, so that answers are brought to the blocks and the blocks never move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            # Codes in order of first appearance, so that frequent words have small ones.
            codes, vocab = pd.factorize(np.concatenate([np.zeros(0, np.uint64), *held]))
            row = (number, squeeze(np.array([d or 0 for d in ids], "<i8")), squeeze(np.array([d is not None for d in ids])), squeeze(np.array([len(h) for h in held], "<i8")), _planes(vocab.astype("<u8")), _planes(codes.astype("<u4")))
            return _batch(BLOCK, [[x] for x in row])

        for b in batches:
            for d, t in zip(b.column(0), b.column(1)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                ids.append(d.as_py())
                held.append(hashes(words(raw)))
                size += len(raw) + 16
                if size >= block_bytes:
                    yield out()
                    number, ids, held, size = number + 1, [], [], 0
        if held:
            yield out()

    spark, name = docs.sparkSession, f"skyweave_{uuid.uuid4().hex}"
    texts(docs).mapInArrow(run, BLOCK).write.bucketBy(partitions(spark), "block").option("path", workdir(spark)).option("compression", "none").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone; the files stay in the shared folder
    return table


def each(fn: Callable[[Block, dict], Iterator[pa.RecordBatch]]):
    """fn over the rows of blocks, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                yield from fn(Block.opened(row), row)

    return run


# records


@dataclass
class Records:
    """Distinct records: a key, perhaps a second number (tie) that tells records of one key apart and further numbers (extra) of theirs,
    a count, and how many blocks have the record."""

    keys: np.ndarray
    counts: np.ndarray
    ties: np.ndarray | None = None
    extra: np.ndarray | None = None
    senders: np.ndarray | None = None

    def sorted(self) -> tuple["Records", np.ndarray]:
        order = np.argsort(self.keys, kind="stable") if self.ties is None else np.lexsort((self.ties, self.keys))
        return self.at(order), order

    def at(self, i) -> "Records":
        pick = lambda a: None if a is None else a[i]
        return Records(self.keys[i], self.counts[i], pick(self.ties), pick(self.extra), pick(self.senders))


@dataclass
class Ranges:
    """How keys are cut: `levels` times into `fan` ranges of equal width, by teams of about `fan` of the `blocks`."""

    fan: int
    levels: int
    blocks: int

    @classmethod
    def of(cls, table: DataFrame, fanout: int = FANOUT) -> "Ranges":
        blocks = table.count()
        need = max(partitions(table.sparkSession), 2 * blocks, 2)
        levels = 1
        while fanout**levels < need:
            levels += 1
        return cls(math.ceil(need ** (1 / levels)), levels, blocks)

    def sent(self, kind: int, sender: int, records: Records, level: int = 1, parent: int = 0) -> pa.RecordBatch:
        """Rows of SENT for sorted records, whose keys lie in the range `parent` of the level above."""
        cuts, r = self.fan**level, records
        edges = np.searchsorted(r.keys, np.array([-(-(i << 64) // cuts) for i in range(parent * self.fan + 1, (parent + 1) * self.fan)], np.uint64)).tolist()
        rows = [(i, r.at(slice(a, b))) for i, (a, b) in enumerate(zip([0, *edges], [*edges, len(r.keys)]), parent * self.fan) if a < b]
        n, none = len(rows), lambda a, kind: None if a is None else _planes(a.astype(kind))
        return _batch(SENT, [[kind] * n, [i for i, _ in rows], [sender] * n, [_planes(x.keys) for _, x in rows], [none(x.ties, "<u8") for _, x in rows], [_planes(x.counts.astype("<u8")) for _, x in rows], [none(x.senders, "<u8") for _, x in rows], [none(x.extra, "<u4") for _, x in rows]])


def _merged(t: pa.Table) -> tuple[Records, list[np.ndarray]]:
    """The distinct records of some rows of SENT, sorted, and for each row the places of its own among them."""
    keys = [_numbers(x.as_py(), "<u8") for x in t.column("keys")]
    whole = np.concatenate(keys)
    column = lambda name, kind: None if t.column(name)[0].as_py() is None else np.concatenate([_numbers(x.as_py(), kind) for x in t.column(name)])
    counts, ties, extra, senders = column("counts", "<u8"), column("ties", "<u8"), column("extra", "<u4"), column("senders", "<u8")
    r, order = Records(whole, counts, ties, None if extra is None else extra.reshape(len(whole), -1), np.ones(len(whole), np.uint64) if senders is None else senders).sorted()
    # Neighbours in sorted order are compared; equal ones are one record.
    new = r.keys[1:] != r.keys[:-1] if ties is None else (r.keys[1:] != r.keys[:-1]) | (r.ties[1:] != r.ties[:-1])
    first = np.flatnonzero(np.concatenate([[True], new]))
    place = np.empty(len(whole), np.int64)
    place[order] = np.cumsum(np.concatenate([[0], new]))
    out = r.at(first)
    out.counts, out.senders = np.add.reduceat(r.counts, first), np.add.reduceat(r.senders, first)
    return out, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def _reply(t: pa.Table, answer: np.ndarray, places: list[np.ndarray]) -> pa.Table:
    return t.select(["kind", "bucket", "sender"]).append_column("answer", pa.array([_planes(answer[p]) for p in places], pa.binary()))


#: What a range makes of its records: an answer for each, and a summary of the range or None.
Solve = Callable[[int, Records], tuple[np.ndarray, bytes | None]]


def answered(rows: DataFrame, ranges: Ranges, solve: Solve, answer_type: str) -> DataFrame:
    """For rows of SENT the answers to each block's records, in their order. Summaries of ranges have a NULL sender."""
    return _answered(rows, ranges, solve, answer_type, 1, ranges.blocks)


def _answered(rows: DataFrame, ranges: Ranges, solve: Solve, answer_type: str, level: int, senders: int) -> DataFrame:
    if level == ranges.levels:

        def leaf(t: pa.Table) -> pa.Table:
            records, places = _merged(t)
            answer, summary = solve(t.column("kind")[0].as_py(), records)
            out = _reply(t, answer.astype(answer_type), places)
            if summary is not None:
                out = pa.concat_tables([out, pa.table({"kind": t.column("kind")[:1], "bucket": t.column("bucket")[:1], "sender": pa.array([None], pa.int64()), "answer": pa.array([summary], pa.binary())})])
            return out

        return rows.groupBy("kind", "bucket").applyInArrow(leaf, ANSWERED)
    teams = -(-senders // ranges.fan)
    rows, _ = save(rows.withColumn("team", F.pmod(F.xxhash64("sender"), F.lit(teams))), compression="none")

    def merge(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([ranges.sent(t.column("kind")[0].as_py(), t.column("team")[0].as_py(), _merged(t)[0], level + 1, t.column("bucket")[0].as_py())])

    def pass_on(t: pa.Table, replies: pa.Table) -> pa.Table:
        order = np.argsort(replies.column("bucket").to_numpy())
        answer = np.concatenate([_numbers(replies.column("answer")[int(i)].as_py(), answer_type) for i in order])
        return _reply(t, answer, _merged(t)[1])

    own = ["kind", "bucket", "team"]
    replies, _ = save(_answered(rows.groupBy(own).applyInArrow(merge, SENT), ranges, solve, answer_type, level + 1, teams), compression="none")
    within = replies.where("sender IS NOT NULL").select("kind", F.floor(F.col("bucket") / ranges.fan).alias("parent"), F.col("sender").alias("team"), "bucket", "answer")
    back = rows.groupBy(own).cogroup(within.groupBy("kind", "parent", "team")).applyInArrow(pass_on, ANSWERED)
    return back.unionByName(replies.where("sender IS NULL"))


def with_answers(table: DataFrame, answers: DataFrame) -> DataFrame:
    """The blocks, each with `answers`: [(kind, bucket, answer)] in order."""
    own = answers.where("sender IS NOT NULL").groupBy(F.col("sender").alias("block")).agg(F.array_sort(F.collect_list(F.struct("kind", "bucket", "answer"))).alias("answers"))
    return table.join(own, "block", "left")


def received(row: dict, kind: int, answer_type: str) -> np.ndarray:
    """A block's answers of one kind, in the order of its sorted records."""
    parts = [_numbers(x["answer"], answer_type) for x in row["answers"] or () if x["kind"] == kind]
    return np.concatenate([np.zeros(0, answer_type), *parts])
