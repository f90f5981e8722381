"""Decoding of stored values: fills, valid ranges, scales. Each gives NULL for a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def no_nan(v: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(v.cast("double")), v)


def fill(v: Column, *fills: float) -> Column:
    out = v
    for x in fills:
        out = F.nullif(out, F.lit(x))
    return out


def valid_range(v: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Applied before scaling."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (v >= F.lit(lo))
    if hi is not None:
        ok = ok & (v <= F.lit(hi))
    return F.when(ok, v)


def scale_cf(v: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return v * F.lit(float(scale)) + F.lit(float(offset))


def scale_modis(v: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return (v - F.lit(float(offset))) * F.lit(float(scale))


def scale_caliop(v: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return F.try_divide(v, F.lit(float(scale))) + F.lit(float(offset))


def scale_cloudsat(v: Column, factor: float = 1.0, offset: float = 0.0) -> Column:
    return F.try_divide(v - F.lit(float(offset)), F.lit(float(factor)))


def parse_range(text: str) -> tuple[float, float]:
    """A range written `a...b`."""
    a, b = text.split("...")
    return float(a), float(b)


def missing_where(v: Column, op: str, missing: float) -> Column:
    """NULL where `v op missing`; op is one of < <= == => >."""
    m = F.lit(float(missing))
    tests = {"<": v < m, "<=": v <= m, "==": v == m, "=>": v >= m, ">=": v >= m, ">": v > m}
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return F.when(~tests[op], v)


def broadcast_profile(profiles: DataFrame, levels: DataFrame) -> DataFrame:
    """Each profile at each level: a 1-D coordinate repeated along the other axis. The levels are an axis, so they are few."""
    return profiles.crossJoin(F.broadcast(levels))


def equal_including_missing(a: Column, b: Column) -> Column:
    """Whether two values are equal; NaN equals NaN and NULL equals NULL."""
    return a.eqNullSafe(b) | F.coalesce(F.isnan(a.cast("double")) & F.isnan(b.cast("double")), F.lit(False))


def same_values(a: DataFrame, b: DataFrame, key: str, column: str) -> bool:
    """Whether a column is equal, row by row, in two tables with the same keys."""
    met = a.select(key, F.col(column).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(key, F.col(column).alias("_b"), F.lit(1).alias("_in_b")), key, "full")
    return met.where(F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~equal_including_missing(F.col("_a"), F.col("_b"))).isEmpty()


def densify_track(df: DataFrame, order: str, columns: list[str], times: int, group: list[str]) -> DataFrame:
    """`times` points from each along a track, linear between neighbours and centred on it; the last is extrapolated.

    Adds `sub` (0 .. times - 1). group: keys of separate tracks (a granule, say), of which each is in one task; at least one is needed.
    """
    if not group:
        raise ValueError("tracks need a key")
    w = Window.partitionBy(*group).orderBy(order)
    out = df
    for c in columns:
        step = F.coalesce(F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w), F.lit(0.0))
        out = out.withColumn(f"_{c}_step", step)
    out = out.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    for c in columns:
        out = out.withColumn(c, F.col(c) + F.col(f"_{c}_step") * (F.col("sub") - (times - 1) / 2) / times).drop(f"_{c}_step")
    return out


def densify_swath(df: DataFrame, row: str, column: str, columns: list[str], times: int, group: list[str], lines: int = 64) -> DataFrame:
    """`times` by `times` points from each of a swath, linear along and across it and centred on the points that are there.

    row, column: whole numbers that place a point in its swath; group: keys of swaths. Adds sub_row and sub_column (0 .. times - 1).
    Points beyond the outermost centres, or beside a place without a point, are NULL, as nothing lies between. times is odd. A swath is
    cut into ranges of `lines` scan lines, and each passes its first and last line to its neighbours; so any length is several tasks.
    """
    if times < 1 or times % 2 == 0:
        raise ValueError("an odd number of points is needed")
    r, at = F.col(row), F.floor(F.col(row) / lines)
    foot = F.pmod(r, F.lit(lines))
    ranges = F.array_compact(F.array(at, F.when(foot == 0, at - 1), F.when(foot == lines - 1, at + 1)))
    out = df.withColumn("_range", F.explode(ranges)).repartition(*group, "_range")
    across = Window.partitionBy(*group, "_range", row).orderBy(column)
    along = Window.partitionBy(*group, "_range", column).orderBy(row)
    half = times // 2

    def between(x: Column, before: Column, after: Column) -> Column:
        """The values of sub-points from one value to its neighbours' sides."""
        ways = [x + (x - before) * (F.lit(k) / times) if k < 0 else x if k == 0 else x + (after - x) * (F.lit(k) / times) for k in range(-half, half + 1)]
        return F.array(*ways)

    def beside(c: str, n: int, over, place: str) -> Column:
        return F.when(F.lag(place, n).over(over) == F.col(place) - n, F.lag(c, n).over(over))

    out = out.withColumns({f"_a_{c}": between(F.col(c), beside(c, 1, across, column), beside(c, -1, across, column)) for c in columns})
    near = {f"_{k}_{c}": beside(f"_a_{c}", n, along, row) for c in columns for k, n in (("p", 1), ("n", -1))}
    out = out.withColumns(near).where(F.col("_range") == at)
    out = out.withColumn("sub_row", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("sub_column", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    share = (F.col("sub_row") - half) / times
    for c in columns:
        x, p, n = (F.get(f"_{k}_{c}", F.col("sub_column")) for k in "apn")
        out = out.withColumn(c, F.when(share < 0, x + (x - p) * share).when(share > 0, x + (n - x) * share).otherwise(x))
    return out.drop("_range", *[f"_{k}_{c}" for c in columns for k in "apn"])


def ingest(df: DataFrame, coords: list[str], variables: list[str]) -> DataFrame:
    """NaN to NULL in coordinates and variables; rows with a missing coordinate go."""
    types = dict(df.dtypes)
    clean = {c: no_nan(F.col(c)) for c in [*coords, *variables] if types[c] in ("float", "double")}
    out = df.withColumns(clean) if clean else df
    for c in clean:
        if df.schema[c].metadata:
            out = out.withMetadata(c, df.schema[c].metadata)
    return out.dropna(subset=list(coords)) if coords else out
