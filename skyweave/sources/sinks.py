"""Sinks: tables with their metadata, and gridded data with its axes beside it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Axis


def annotate(df: DataFrame, variables: dict[str, dict], history: str | None = None) -> DataFrame:
    """Add attributes to variables' metadata; history is appended to what is there."""
    for name, extra in variables.items():
        meta = {**(df.schema[name].metadata or {}), **extra}
        if history:
            meta["history"] = "\n".join(x for x in (meta.get("history"), history) if x)
        df = df.withMetadata(name, meta)
    return df


def remove_attribute(df: DataFrame, name: str, key: str) -> DataFrame:
    return df.withMetadata(name, {k: v for k, v in (df.schema[name].metadata or {}).items() if k != key})


def save(df: DataFrame, path: str, *, overwrite: bool = False, partition_by: list[str] = ()) -> None:
    """Parquet; field metadata is kept in its schema."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def save_points(df: DataFrame, path: str, *, cell: float = 10.0, overwrite: bool = False) -> None:
    """Points laid out by coarse cells of latitude and longitude (lat_cell, lon_cell); filters on these columns read few files."""
    keyed = df.withColumns({"lat_cell": F.floor(F.col("latitude") / cell).cast("int"), "lon_cell": F.floor(F.col("longitude") / cell).cast("int")})
    save(keyed.repartition("lat_cell", "lon_cell"), path, overwrite=overwrite, partition_by=["lat_cell", "lon_cell"])


def save_grid(df: DataFrame, axes: list[Axis], path: str, *, overwrite: bool = False) -> None:
    """The long form under <path>/cells and each axis under <path>/axes."""
    save(df, f"{path}/cells", overwrite=overwrite)
    rows = [(a.name, i, float(p), float(lo), float(hi)) for a in axes for i, (p, lo, hi) in enumerate(zip(a.points, a.lo, a.hi))]
    save(df.sparkSession.createDataFrame(rows, "axis string, i int, point double, lo double, hi double"), f"{path}/axes", overwrite=overwrite)


def axes_of(spark, path: str) -> list[Axis] | None:
    """The axes of a grid, or None where there are none: a table of points, or another file."""
    try:
        return None if "*" in path else read_axes(spark, path)
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def warn_of_space(df: DataFrame, path: str) -> str | None:
    """A warning if what the table is made from is larger than what the path's file system has left; None if not, or if its size is unknown,
    as without a JVM at hand (Spark Connect)."""
    spark = df.sparkSession
    if getattr(spark, "_jvm", None) is None:
        return None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    need = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    files, folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.getParent()
    while folder is not None and not files.exists(folder):
        folder = folder.getParent()
    left = (files.getStatus(folder) if folder is not None else files.getStatus()).getRemaining()
    return f"about {human_size(need)} to write, {human_size(left)} left" if left < need < 1 << 62 else None


def human_size(n: float) -> str:
    for unit in ("bytes", "kB", "MB", "GB", "TB"):
        if n < 1000:
            return f"{n:.4g} {unit}"
        n /= 1000
    return f"{n:.4g} PB"


def read_axes(spark, path: str) -> list[Axis]:
    """The axes that save_grid() wrote: they are small by nature."""
    out: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/axes").orderBy("axis", "i").collect():
        out.setdefault(r.axis, []).append((r.point, r.lo, r.hi))
    return [Axis(n, *map(tuple, zip(*rows))) for n, rows in out.items()]
