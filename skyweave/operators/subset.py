"""Subsetting by coordinate ranges, dates and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NoDataInSubsetError
from ..functions.geo import parse_polygon, polygon_box, wrap_longitude
from ..functions.names import find_coordinate
from ..functions.time import PartialDateTime, limit_days
from .polygon import mark_inside


def _limits(x) -> tuple:
    """(start, end) of a slice, a pair, one value or one partial date; an open end is None."""
    if isinstance(x, slice):
        return x.start, x.stop
    if isinstance(x, (PartialDateTime, str)):
        return x, x
    x = tuple(x)
    return x * 2 if len(x) == 1 else x


def longitude_start(df: DataFrame, column: str, lo: float | None, hi: float | None) -> float | None:
    """Where longitudes must begin for the limits to fit: 0 for data in -180..180 with a limit above 180 and none negative, -180 for
    the converse, else None (as they are). Two numbers are read from the data, and only if a limit is out of one range."""
    given = [x for x in (lo, hi) if x is not None]
    up, down = bool(given) and max(given) > 180 and min(given) >= 0, bool(given) and min(given) < 0 and max(given) <= 180
    if not (up or down):
        return None
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if ends.a is None:
        return None
    if up and ends.a < 0 and ends.b <= 180:
        return 0.0
    return -180.0 if down and ends.a >= 0 and ends.b > 180 else None


def subset(df: DataFrame, shape: str | None = None, where: Column | None = None, **limits) -> DataFrame:
    """Rows within all limits, both ends included. Keys are coordinates or axis letters; values are pairs, slices, one value, or
    (partial) dates for time. Longitudes are shifted by 360 where the limits ask for the other range, and stay so. shape: WKT
    polygon, its boundary excluded. where: a user's own condition. Missing coordinates fail every test.
    """
    out, test = df, F.lit(True)
    for key, x in limits.items():
        column = find_coordinate(df, key)
        lo, hi = _limits(x)
        if dict(df.dtypes)[column].startswith("timestamp"):
            as_time = lambda t, up: limit_days(t, up) and F.timestamp_micros(F.lit(round((limit_days(t, up) - 135140) * 86400e6)))
            lo, hi = as_time(lo, False) if lo is not None else None, as_time(hi, True) if hi is not None else None
        else:
            lo, hi = limit_days(lo, False), limit_days(hi, True)
        if column == find_or_none(df, "longitude"):
            start = longitude_start(df, column, lo, hi)
            if start is not None:
                out = out.withColumn(column, wrap_longitude(F.col(column), start))
        if lo is not None:
            test = test & (F.col(column) >= lo)
        if hi is not None:
            test = test & (F.col(column) <= hi)
    if shape is not None:
        rings = parse_polygon(shape)
        x, y = find_coordinate(df, "longitude"), find_coordinate(df, "latitude")
        x1, y1, x2, y2 = polygon_box(rings)
        # The box is tested first, where a scan may use it.
        out = mark_inside(out.where(test & F.col(x).between(x1, x2) & F.col(y).between(y1, y2)), rings, x, y, "_inside")
        out, test = out.where("_inside").drop("_inside"), F.lit(True)
    if where is not None:
        test = test & where
    return out.where(test)


def find_or_none(df: DataFrame, key: str) -> str | None:
    try:
        return find_coordinate(df, key)
    except Exception:
        return None


def subset_grid(df: DataFrame, variables: list[str], shape: str | None = None, **limits) -> DataFrame:
    """Cells of a long-form grid. A coordinate without bounds is tested by its point; longitude is cyclic, and is wrapped to begin at
    the lower limit; with <name>_lo and <name>_hi a cyclic coordinate's cell stays if its bounds touch the range. shape: cells
    outside become NULL, and stay.
    """
    out, test = df, F.lit(True)
    for key, x in limits.items():
        c = find_coordinate(df, key)
        lo, hi = (limit_days(v, bool(k)) for k, v in enumerate(_limits(x)))
        low, high = (f"{c}_lo", f"{c}_hi") if f"{c}_lo" in df.columns and c in ("longitude", "latitude") else (c, c)
        if c == "longitude" and lo is not None and hi is not None:
            # Shift each cell so that its upper bound (or its point) is the first at or past the lower limit.
            move = wrap_longitude(F.col(high), lo) - F.col(high)
            out = out.withColumns({n: F.col(n) + move for n in dict.fromkeys((c, low, high))})
        if lo is not None:
            test = test & (F.col(high) >= lo)
        if hi is not None:
            test = test & (F.col(low) <= hi)
    out = out.where(test)
    if shape is not None:
        rings = parse_polygon(shape)
        out = mark_inside(out, rings, "longitude", "latitude", "_inside")
        out = out.withColumns({v: F.when(F.col("_inside"), F.col(v)) for v in variables}).drop("_inside")
    return out


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise NoDataInSubsetError("no data in the subset")
    return df
