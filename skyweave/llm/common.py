"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import save, workdir

def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that save() wrote, through Hadoop's file system, so that any store works. Without a JVM at hand (Spark Connect) it
    is left to whoever empties the folder."""
    if getattr(spark, "_jvm", None) is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty); other columns, whatever their names, are left aside."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


T = TypeVar("T")
_kept: list[tuple[Hashable, object]] = []


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """What make() gives, made once in a worker, which serves many tasks. A worker keeps one such thing: that of an earlier operator, and
    the words it remembers, are dropped and their memory given back to the system before the next is made."""
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        _kept.append((key, make()))
    return _kept[0][1]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that Python's copies of texts stay small beside the batch."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, which it does when the driver collects garbage: soon
    after this, or, without a JVM at hand (Spark Connect), at its next collection."""
    gc.collect()
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        jvm.System.gc()


def smallest_hashes(df: DataFrame, n: int, salt: str, key: str = "doc_id", total: int | None = None) -> DataFrame:
    """The n rows of smallest hash of `key`. A threshold on the hash passes about three times as many, so that tasks send the driver
    few rows however many tasks there are."""
    total = df.count() if total is None else total
    h = F.xxhash64(key, F.lit(salt))
    near = df.where(F.pmod(h, F.lit(1 << 30)) < int(min(1.0, (3 * n + 100) / max(total, 1)) * (1 << 30)))
    return near.orderBy(F.pmod(h, F.lit(1 << 30)), key).limit(n)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unsigned_hex(c: Column) -> Column:
    """A 64-bit number as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


__all__ = ["drop", "kept", "partitions", "release", "save", "slices", "smallest_hashes", "table", "texts", "unsigned_hex", "workdir"]
