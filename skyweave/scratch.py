"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workdir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only in local mode (tests) may that setting be absent: a local folder is made then, and removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="skyweave-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/skyweave/{uuid.uuid4().hex}"


def save(df: DataFrame, path: str | None = None, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there, so a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = path or workdir(spark)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
