"""Kernels: named lists of aggregate columns for joins, bins and collapses."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ClassNotFoundError
from ..scratch import save


def _moments(v: str) -> list[Column]:
    n = F.count(v)
    return [F.avg(v).alias(v), F.stddev_samp(v).alias(f"{v}_std_dev"), F.when(n > 0, n).alias(f"{v}_num_points")]


def _gmean(v: str) -> Column:
    """0 if a value is 0, NULL if one is negative."""
    least = F.min(v)
    return F.when(least > 0, F.exp(F.avg(F.when(F.col(v) > 0, F.ln(v))))).when(least == 0, F.lit(0.0)).alias(v)


def _hmean(v: str) -> Column:
    """0 if a value is 0, NULL if one is negative."""
    least = F.min(v)
    return F.when(least > 0, F.count(v) / F.sum(F.try_divide(F.lit(1.0), F.col(v)))).when(least == 0, F.lit(0.0)).alias(v)


def spline_peak(values: np.ndarray, steps: int = 100) -> float | None:
    """The maximum of the not-a-knot cubic spline through the values at 0, 1, 2, ...; with under four, of the polynomial."""
    y = np.asarray(values, float)
    y = y[~np.isnan(y)]
    n = len(y)
    if n == 0:
        return None
    if n == 1:
        return float(y[0])
    x = np.linspace(0, n - 1, steps * (n - 1) + 1)
    if n < 4:
        return float(np.polyval(np.polyfit(np.arange(n), y, n - 1), x).max())
    # Second derivatives m: m[i-1] + 4 m[i] + m[i+1] = 6 (y[i-1] - 2 y[i] + y[i+1]); third derivative continuous next to the ends.
    a, b = np.zeros((n, n)), np.zeros(n)
    a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        b[i] = 6 * (y[i - 1] - 2 * y[i] + y[i + 1])
    m = np.linalg.solve(a, b)
    i = np.minimum(x.astype(int), n - 2)
    u = x - i
    s = (1 - u) * y[i] + u * y[i + 1] + ((1 - u) ** 3 - (1 - u)) * m[i] / 6 + (u**3 - u) * m[i + 1] / 6
    return float(s.max())


@F.pandas_udf(T.DoubleType())
def _peak_udf(v: pd.Series) -> pd.Series:
    return v.map(lambda a: spline_peak(np.array([x for x in a if x is not None], float)))


def peak(v: str, order: str | Column) -> Column:
    """The spline maximum of a variable along an axis; a series is one cell's values along one axis, so it is short."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order) if isinstance(order, str) else order, F.col(v).cast("double").alias("v"))))
    return _peak_udf(F.transform(rows, lambda r: r["v"])).alias(v)


#: Kernels of the values alone.
DATA_ONLY: dict[str, Callable[[str], list[Column]]] = {
    "moments": _moments,
    "mean": lambda v: [F.avg(v).alias(v)],
    "stddev": lambda v: [F.stddev_samp(v).alias(v)],
    "min": lambda v: [F.min(v).alias(v)],
    "max": lambda v: [F.max(v).alias(v)],
    "sum": lambda v: [F.sum(v).alias(v)],
    "median": lambda v: [F.median(v).alias(v)],
    "gmean": lambda v: [_gmean(v)],
    "hmean": lambda v: [_hmean(v)],
    "RMS": lambda v: [F.sqrt(F.avg(F.col(v) * F.col(v))).alias(v)],
}


def medians(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """The exact median of each variable for each combination of keys, without a group in one task.

    Values are counted; the counts are written in ranges of (keys, value), and running counts within a range are added to the totals of
    the key's earlier ranges, of which there are as many rows as ranges and keys. The median is where they pass the middle.
    """
    out, parts = df.select(*keys).distinct(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for v in variables:
        n = df.select(*keys, F.col(v).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
        n, _ = save(n.repartitionByRange(parts, *keys, "_v").withColumn("_b", F.spark_partition_id()))
        totals = n.groupBy(*keys, "_b").agg(F.sum("_n").alias("_t"))
        own, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"), F.sum("_t").over(own).alias("_all"))
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
        n = n.join(totals, [*keys, "_b"]).withColumn("_upto", upto)
        middle = lambda extra: F.min(F.when(F.col("_upto") >= F.floor((F.col("_all") + extra) / 2), F.col("_v")))
        out = out.join(n.groupBy(*keys).agg(((middle(1) + middle(2)) / 2).alias(v)), keys, "left")
    return out


#: Kernels of the nearest point, by what is nearest.
NEAREST = {"nn_horizontal": "h", "nn_h": "h", "nn_altitude": "a", "nn_a": "a", "nn_pressure": "p", "nn_p": "p", "nn_time": "t", "nn_t": "t"}


def from_sums(name: str, v: str, middle: float) -> list[Column]:
    """A kernel's columns from a count, a sum and a sum of squares about `middle`, the least and the greatest value (k_, s_, q_, l_, g_)."""
    k, s, q = (F.col(f"{c}_{v}") for c in "ksq")
    mean = F.when(k > 0, s / k + middle).alias(v)
    spread = F.when(k > 1, F.sqrt(F.greatest(q - s * s / k, F.lit(0.0)) / (k - 1)))
    return {
        "mean": lambda: [mean],
        "stddev": lambda: [spread.alias(v)],
        "moments": lambda: [mean, spread.alias(f"{v}_std_dev"), F.when(k > 0, k).alias(f"{v}_num_points")],
        "min": lambda: [F.col(f"l_{v}").alias(v)],
        "max": lambda: [F.col(f"g_{v}").alias(v)],
        "sum": lambda: [F.when(k > 0, s + k * middle).alias(v)],
        "RMS": lambda: [F.when(k > 0, F.sqrt(q / k)).alias(v)],
    }[name]()


def from_terms(name: str, v: str, middle: float) -> Column:
    """gmean or hmean from the sums of v (k_, l_) and of its logarithms or reciprocals _t_<v> about `middle`."""
    k, least, n, s = F.col(f"k_{v}"), F.col(f"l_{v}"), F.col(f"k__t_{v}"), F.col(f"s__t_{v}")
    some = F.exp(s / n + middle) if name == "gmean" else k / (s + n * middle)
    return F.when((k > 0) & (least > 0), some).when((k > 0) & (least == 0), F.lit(0.0)).alias(v)


#: Kernels that from_sums() makes; sum and RMS are of sums about 0.
FROM_SUMS = ("mean", "stddev", "moments", "min", "max", "sum", "RMS")


def data_only(name: str, variables: list[str], extra: dict | None = None) -> list[Column]:
    """The aggregate columns of a kernel for all variables; extra: users' kernels by name."""
    fn = (extra or {}).get(name) or DATA_ONLY.get(name)
    if fn is None:
        raise ClassNotFoundError(f"no kernel {name!r}; known: {sorted([*DATA_ONLY, *NEAREST])}")
    return [c for v in variables for c in fn(v)]


def output_names(name: str, variables: list[str]) -> list[str]:
    return [n for v in variables for n in ([v, f"{v}_std_dev", f"{v}_num_points"] if name == "moments" else [v])]
