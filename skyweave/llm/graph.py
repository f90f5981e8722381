"""Connected components by alternating large-star and small-star steps, on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save, workdir


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a bigint, b bigint): root is the smallest node reachable. Self-loops and repeats do no harm.

    Every round is one grouping by node with partial aggregation and one join; it ends when a round changes nothing.
    """
    spark = edges.sparkSession
    e, path = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), workdir(spark))
    state = None
    while True:
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (sign.n, sign.h) == state or sign.n == 0:
            break
        state = (sign.n, sign.h)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large, large_path = save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), workdir(spark))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e, new = save(small, workdir(spark))
        drop(spark, large_path)
        drop(spark, path)
        path = new
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
