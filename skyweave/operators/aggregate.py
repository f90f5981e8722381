"""Binned aggregation of points, and collapse of grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CoordinateNotFoundError
from ..functions.geo import wrap_longitude, wrap_start
from ..functions.names import find_coordinate
from . import kernels
from .grid import Axis, cell_number, spine, with_axes

#: Metres, of the sphere that areas are measured on.
AREA_RADIUS = 6_367_470.0


def resolve_grid(df: DataFrame, grid: dict) -> list[Axis]:
    """Axes from {coordinate or letter: (start, stop, step)}; an open start or stop is the data's least or greatest value."""
    named = {}
    for key, x in grid.items():
        start, stop, step = (x.start, x.stop, x.step) if isinstance(x, slice) else x
        if step is None:
            raise ValueError(f"a step is needed for {key!r}")
        named[find_coordinate(df, key)] = [start, stop, step]
    open_ = [c for c, x in named.items() if x[0] is None or x[1] is None]
    if open_:
        ends = df.agg(*[f(c).alias(f"{k}_{c}") for c in open_ for k, f in (("a", F.min), ("b", F.max))]).first()
        for c in open_:
            named[c][0] = ends[f"a_{c}"] if named[c][0] is None else named[c][0]
            named[c][1] = ends[f"b_{c}"] if named[c][1] is None else named[c][1]
    return [Axis.regular(c, *map(float, x)) for c, x in named.items()]


def aggregate(df: DataFrame, variables: list[str], how: str = "moments", grid: dict | None = None, *, coords: list[str] | None = None, dense: bool = True, user_kernels: dict | None = None) -> DataFrame:
    """Points in the cells of a grid. Cells are half-open; empty ones are there with NULL in every output (dense=False: absent).

    Coordinates that the grid leaves out are collapsed to one cell: point, lower and upper bound are their mid, least and greatest
    values (constant columns, added for `coords`). Outputs that clash with a coordinate are called aggregated_<name>.
    """
    axes = resolve_grid(df, grid or {})
    for a in axes:
        if a.name == "longitude":
            # Longitudes are brought to the range that begins where the grid does, or at its natural start.
            start = wrap_start(a.lo[0])
            df = df.withColumn("longitude", wrap_longitude(F.col("longitude"), a.lo[0] if a.lo[0] < start or a.hi[-1] > start + 360 else start))
    index = {a.name: a.index(F.col(a.name)) for a in axes}
    rest = [c for c in coords or [] if c not in index]
    outs = kernels.output_names(how, variables)
    renamed = {o: f"aggregated_{o}" for o in outs if o in df.columns and o in (coords or [])}
    binned = df.withColumn("cell", cell_number(axes, index)).where("cell IS NOT NULL") if axes else df.withColumn("cell", F.lit(0).cast("long"))
    if how == "median" and how not in (user_kernels or {}):
        agg = kernels.medians(binned, ["cell"], variables)
    else:
        agg = binned.groupBy("cell").agg(*kernels.data_only(how, variables, user_kernels))
    if dense:
        out = spine(df.sparkSession, axes).join(agg, "cell", "left") if axes else df.sparkSession.range(1).select(F.col("id").alias("cell")).join(agg, "cell", "left")
    else:
        out = with_axes(agg, axes)
    if rest:
        ends = df.agg(*[f(c).alias(f"{c}{k}") for c in rest for k, f in (("_lo", F.min), ("_hi", F.max))])
        ends = ends.select("*", *[(F.col(f"{c}_lo") + (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / 2).alias(c) for c in rest])
        out = out.crossJoin(F.broadcast(ends))  # one row
    return out.withColumnsRenamed(renamed) if renamed else out


def area_weight(lat_lo: Column, lat_hi: Column, lon_lo: Column | None = None, lon_hi: Column | None = None) -> Column:
    """The area in square metres of a cell; without longitude bounds, of the whole circle of latitude."""
    width = F.radians(lon_hi - lon_lo) if lon_lo is not None else F.lit(2 * math.pi)
    return F.lit(AREA_RADIUS**2) * width * (F.sin(F.radians(lat_hi)) - F.sin(F.radians(lat_lo)))


WEIGHTED = ("mean", "sum", "RMS", "moments")


def collapse(df: DataFrame, variables: list[str], dims: list[str], collapsed: list[str], how: str = "moments", *, aux: list[str] = (), weight: Column | None = None, user_kernels: dict | None = None) -> DataFrame:
    """Collapse some dimensions of a long-form grid: one row for each combination of the others.

    With latitude among them mean, sum, RMS and the mean of moments are weighted by area, from <dim>_lo and <dim>_hi if there, else by
    `weight`. Counts of all-missing cells are 0. aux: coordinates of several dimensions, averaged.
    """
    missing = [c for c in collapsed if c not in df.columns]
    if missing:
        raise CoordinateNotFoundError(f"no coordinate {missing}")
    keep = [d for d in dims if d not in collapsed]
    if how not in kernels.DATA_ONLY and how not in (user_kernels or {}) and how != "peak":
        raise KeyError(how)
    if weight is None and "latitude" in collapsed and how in WEIGHTED and "latitude_lo" in df.columns:
        lon = [F.col("longitude_lo"), F.col("longitude_hi")] if "longitude_lo" in df.columns else [None, None]
        weight = area_weight(F.col("latitude_lo"), F.col("latitude_hi"), *lon)
    cols: list[Column] = []
    for v in variables:
        x = F.col(v)
        if weight is not None and how in WEIGHTED:
            w = F.when(x.isNotNull(), weight)
            mean = F.try_divide(F.sum(w * x), F.sum(w))
            cols += {"mean": [mean.alias(v)], "sum": [F.sum(w * x).alias(v)], "RMS": [F.sqrt(F.try_divide(F.sum(w * x * x), F.sum(w))).alias(v)], "moments": [mean.alias(v), F.stddev_samp(x).alias(f"{v}_std_dev"), F.count(x).alias(f"{v}_num_points")]}[how]
        elif how == "moments":
            cols += [F.avg(x).alias(v), F.stddev_samp(x).alias(f"{v}_std_dev"), F.count(x).alias(f"{v}_num_points")]
        elif how == "peak":
            cols.append(kernels.peak(v, collapsed[0]))
        else:
            cols += kernels.data_only(how, [v], user_kernels)
    cols += [F.avg(c).alias(c) for c in aux]
    if how == "median" and keep and not aux and how not in (user_kernels or {}):
        return kernels.medians(df, keep, variables)
    return df.groupBy(*keep).agg(*cols) if keep else df.agg(*cols)
