"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Lengths are at most `capacity`, so the packing is planned on the histogram of lengths, which is
bounded whatever the corpus: a plan of bin patterns with multiplicities. Documents then take the
slots of their length by rank, which needs counts by (part, length) only. No document meets the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import WordEncoder, chunks
from .common import save, slices, texts

PIECE = "part int, doc_id bigint, piece int, start bigint, length bigint, local bigint, ids_crc32 bigint, ids binary"


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Pack a histogram of lengths. Returns slots (length, lowest rank, sequence of that rank, offset), sorted, and the number of sequences.

    A bin is filled greedily with the longest unpacked length that fits its gap. Then its shortest item is
    exchanged for two unpacked ones if they fill the gap that it leaves more tightly, as long as that helps.
    The pattern so found is used as often as the counts allow.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    lengths = np.arange(capacity + 1)
    taken, slots, sequences, longest = np.zeros(capacity + 1, np.int64), [], 0, capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            break
        free, items, gap = left, [longest], capacity - longest
        free[longest] -= 1
        while gap:
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            items.append(int(fits[-1]))
            free[items[-1]] -= 1
            gap -= items[-1]
        while gap and len(items) > 1:
            least = items.pop()
            free[least] += 1
            room = gap + least
            below = np.maximum.accumulate(np.where(free[: room + 1] > 0, lengths[: room + 1], 0))
            a = np.flatnonzero(free[: room + 1])
            b = below[np.minimum(room - a, a)]
            alone = (b == a) & (free[a] < 2)
            b[alone] = below[a[alone] - 1]
            both = np.where(b > 0, a + b, 0)
            k = int(both.argmax())
            if both[k] <= least:
                items.append(least)
                free[least] -= 1
                break
            items += [int(a[k]), int(b[k])]
            free[items[-2]] -= 1
            free[items[-1]] -= 1
            gap = room - int(both[k])
        for x in items:
            free[x] += 1
        times = min(int(free[x]) // k for x, k in Counter(items).items())
        offset = 0
        for x in items:
            slots.append((x, taken[x], sequences, offset))
            taken[x] += times
            free[x] -= times
            offset += x
        sequences += times
    return np.array(sorted(slots), np.int64).reshape(-1, 4), sequences


def tokenize(docs: DataFrame, *, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The pieces of every whole text (null: empty) with end_id appended; only documents of over `capacity` ids are cut.

    `local` counts the earlier pieces of the same length in the same part, a task of the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seen = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), Counter()
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        names = [x.split()[0] for x in PIECE.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in slices(batches):
            for some in chunks(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), lambda r: len(r[1])):
                out: list[list] = [[] for _ in names]
                for (d, _), ids in zip(some, enc.encode([t for _, t in some])):
                    ids += end
                    for k in range(0, len(ids), step):
                        cut = ids[k : k + step]
                        n = len(cut) // 4
                        for col, v in zip(out, (part, d, k // step, k // 4, n, seen[n], zlib.crc32(cut), cut)):
                            col.append(v)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return texts(docs).mapInArrow(run, PIECE)


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, ids (little-endian u32), sequence_id, offset.

    Sequences hold at most `capacity` tokens, are gapless from offset 0, and every token of every text is in one.
    Defined cases: null or empty text: the end id alone; null or repeated doc_id: each row is packed;
    empty table: no rows; other columns are ignored. The pieces are written to the shared folder once.
    """
    pieces, _ = save(tokenize(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first, _ = save(counts.select("part", "length", "n", before.alias("before")))
    slots, _ = plan({r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, lowest = slots[:, 0], slots[:, 1]
        ends = np.searchsorted(length, np.arange(capacity + 2))
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for x in np.unique(n):
                own = np.flatnonzero(n == x)
                k = ends[x] + np.searchsorted(lowest[ends[x] : ends[x + 1]], rank[own], "right") - 1
                seq[own], off[own] = slots[k, 2] + rank[own] - lowest[k], slots[k, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "local", "length")), pa.array(seq), pa.array(off)], names=["part", "local", "length", "sequence_id", "offset"])

    # first has a row for each part and length, which grows with the corpus: both sides are shuffled, by keys that the next join has too.
    keys = pieces.select("part", "length", "local").join(first.select("part", "length", "before").hint("merge"), ["part", "length"])
    placed = keys.select("part", "local", "length", (F.col("before") + F.col("local")).alias("rank")).mapInArrow(place, "part int, local bigint, length bigint, sequence_id bigint, offset bigint")
    return pieces.join(placed, ["part", "length", "local"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """pack()'s rows put together: sequence_id, n_tokens, ids (binary), doc_ids and offsets in order. A sequence is bounded by the capacity."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids", "length")))
    joined = F.aggregate("r", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), joined.alias("ids"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").alias("offsets"))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
