"""Comparison of two variables, pair by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import STANDARD
from ..scratch import save


def common(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs that are both present, as x and y."""
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def average_ranks(pairs: DataFrame, column: str) -> DataFrame:
    """(column, rank): the average rank of each distinct value. Values are counted first; the running count is taken within ranges of
    values, so no task sees all of them: the ranges' totals are added from a table of one row a range. The counts are written with the
    number of their range, which is the partition that Spark's range partitioner gave them."""
    n = pairs.groupBy(column).agg(F.count("*").alias("n"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, _ = save(n.repartitionByRange(parts, column).withColumn("b", F.spark_partition_id()))
    totals = n.groupBy("b").agg(F.sum("n").alias("total"))
    before = totals.select("b", F.coalesce(F.sum("total").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.withColumn("w", within).join(F.broadcast(before), "b").select(column, (F.col("before") + F.col("w") + (F.col("n") + 1) / 2.0).alias(f"rank_{column}"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    p = common(df, x, y)
    ranked = p.join(average_ranks(p, "x"), "x").join(average_ranks(p, "y"), "y")
    return ranked.agg(F.corr("rank_x", "rank_y").alias("spearman"))


def stats(df: DataFrame, x: str, y: str, with_spearman: bool = True) -> DataFrame:
    """One row: num_points, means and sample deviations of both, mean and deviation of the signed difference y - x (abs_) and of
    (y - x) / x without zero denominators (rel_), rank correlation, and the regression of y on x with its slope's standard error."""
    p = common(df, x, y)
    rel = F.try_divide(F.col("y") - F.col("x"), F.col("x"))
    r = F.corr("x", "y")
    error = F.sqrt(F.try_divide((F.lit(1.0) - r * r) * F.var_samp("y"), F.var_samp("x") * (F.count("*") - 2)))
    out = p.agg(
        F.count("*").alias("num_points"), F.avg("x").alias("dataset_mean_1"), F.avg("y").alias("dataset_mean_2"), F.stddev_samp("x").alias("dataset_stddev_1"), F.stddev_samp("y").alias("dataset_stddev_2"),
        F.avg(F.col("y") - F.col("x")).alias("abs_mean"), F.stddev_samp(F.col("y") - F.col("x")).alias("abs_stddev"), F.avg(rel).alias("rel_mean"), F.stddev_samp(rel).alias("rel_stddev"),
        F.regr_slope("y", "x").alias("regression_gradient"), F.regr_intercept("y", "x").alias("regression_intercept"), r.alias("regression_r"), error.alias("regression_stderr"),
    )
    return out.crossJoin(spearman(df, x, y)) if with_spearman else out  # one row each


def taylor(df: DataFrame, variables: list[str], extend: float = 0.0, fold: bool = False) -> DataFrame:
    """Per variable against the first: mean, stddev, gamma (ratio of deviations), bias (scaled difference of means), corr in [-1, 1]."""
    first, out = variables[0], None
    for v in variables:
        p = common(df, first, v)
        row = p.agg(F.lit(v).alias("variable"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("stddev"), F.try_divide(F.stddev_samp("y"), F.stddev_samp("x")).alias("gamma"), F.try_divide(F.avg("y") - F.avg("x"), F.stddev_samp("x")).alias("bias"), F.least(F.greatest(F.corr("x", "y"), F.lit(-1.0)), F.lit(1.0)).alias("corr"))
        out = row if out is None else out.unionByName(row)
    if fold:
        out = out.withColumn("corr", F.abs("corr"))
    return out.withColumn("corr", F.greatest("corr", F.lit(-abs(extend)))) if extend else out


def bin_edges(df: DataFrame, variable: str, bins: int = 10, log: bool = False) -> list[float]:
    """The edges of equal bins from the least to the greatest value, or of bins equal in the logarithm."""
    a, b = df.agg(F.min(variable).cast("double"), F.max(variable).cast("double")).first()
    if a is None:
        return []
    if log:
        if a <= 0:
            raise ValueError("logarithmic bins need positive values")
        return [a * (b / a) ** (i / bins) for i in range(bins + 1)]
    return [a + (b - a) * i / bins for i in range(bins + 1)]


def histogram(df: DataFrame, variable: str, bins: int = 10, group: tuple = ()) -> DataFrame:
    """bin, bin_lo, bin_hi, n: counts in equal bins from least to greatest value, the last one closed; empty bins are absent."""
    v = df.select(F.col(variable).cast("double").alias("v"), *group).where("v IS NOT NULL AND NOT isnan(v)")
    ends = F.broadcast(v.agg(F.min("v").alias("a"), F.max("v").alias("b")))  # one row
    w = (F.col("b") - F.col("a")) / bins
    k = F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("a"), w), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return v.crossJoin(ends).withColumn("bin", k).groupBy(*group, "bin", "a", "b").agg(F.count("*").alias("n")).select(*group, "bin", (F.col("a") + F.col("bin") * w).alias("bin_lo"), (F.col("a") + (F.col("bin") + 1) * w).alias("bin_hi"), "n")


def histogram2d(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """x_bin, y_bin, n over common points; empty bins are absent."""
    p = common(df, x, y)
    ends = F.broadcast(p.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")))  # one row
    k = lambda v, lo, hi: F.least(F.floor(F.coalesce(F.try_divide(F.col(v) - F.col(lo), (F.col(hi) - F.col(lo)) / bins), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return p.crossJoin(ends).groupBy(k("x", "a", "b").alias("x_bin"), k("y", "c", "d").alias("y_bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, variables: list[str]) -> DataFrame:
    """info() with each variable's metadata and the coordinates that it has."""
    meta = {v: df.schema[v].metadata or {} for v in variables}
    coords = ", ".join(c for c in STANDARD if c in df.columns)
    rows = [(v, df.schema[v].dataType.simpleString(), *(None if meta[v].get(k) is None else str(meta[v][k]) for k in ("long_name", "units", "missing_value", "history")), coords) for v in variables]
    known = df.sparkSession.createDataFrame(rows, "variable string, type string, long_name string, units string, missing_value string, history string, coordinates string")
    return info(df, variables).join(F.broadcast(known), "variable")  # a row a variable


def info(df: DataFrame, variables: list[str]) -> DataFrame:
    """variable, total, present, least, greatest of each variable, from one pass."""
    wide = df.agg(F.count("*").alias("total"), *[f(v).alias(f"{k}_{v}") for v in variables for k, f in (("n", F.count), ("a", F.min), ("b", F.max))])
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col("total"), F.col(f"n_{v}").alias("present"), F.col(f"a_{v}").cast("double").alias("least"), F.col(f"b_{v}").cast("double").alias("greatest")) for v in variables])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
