"""Grids from tables of cells: which coordinates are axes, where each cell stands on them, and files merged into one grid.

A cell is a row with its coordinates' values. A coordinate with several values is an axis; one value alone is a scalar, which stays a
column, and becomes an axis where files with different ones are merged. A vertical coordinate that varies from cell to cell, as
heights over orography do, is auxiliary: it stays a column beside the variables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InconsistentDimensionsError
from ..functions.names import coordinates
from ..operators.grid import Axis, cell_number

#: An axis is held by the driver, and broadcast to number cells; a coordinate of more values is no axis.
MOST_POINTS = 100_000
#: Cells of which a smaller share is there are no grid, but points.
LEAST_FULL = 0.5
VERTICAL = ("altitude", "air_pressure")


def regular_step(points: list[float]) -> float | None:
    """The step of ascending points that are evenly spaced, but for rounding."""
    if len(points) < 2:
        return None
    step = (points[-1] - points[0]) / (len(points) - 1)
    return step if all(math.isclose(points[0] + i * step, p, rel_tol=1e-6, abs_tol=abs(step) * 1e-4) for i, p in enumerate(points)) else None


def find_axis(name: str, points: list[float], bounds: list[tuple[float, float]] | None = None) -> Axis:
    """The axis of these points: with their own bounds, else with guessed ones; a longitude whose cells go round is cyclic."""
    step = regular_step(points)
    cyclic = name == "longitude" and step is not None and math.isclose(step * len(points), 360.0, rel_tol=1e-6)
    if bounds is not None and all(lo is not None and hi is not None and lo < hi for lo, hi in bounds):
        a = Axis.bounded(name, bounds, points)
        return Axis(name, a.points, a.lo, a.hi, None, cyclic)
    return Axis.of_points(name, points, cyclic)


def dimensions(cells: DataFrame, auxiliary: tuple[str, ...] | None = None) -> tuple[list[str], list[str]]:
    """The coordinates that are axes, in canonical order, and the auxiliary ones. auxiliary: as far as it is known.

    A vertical coordinate of several values is auxiliary if cells are told apart without it, where that leaves another axis.
    """
    coords = coordinates(cells)
    n = cells.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(c) for c in coords]).first()
    several = [c for c in coords if n[c] > 1]
    if auxiliary is None:
        auxiliary = ()
        for c in (c for c in VERTICAL if c in several):
            rest = [x for x in several if x != c and x not in auxiliary]
            if rest and cells.select(*rest).distinct().count() == n["rows"]:
                auxiliary = (*auxiliary, c)
    axes = [c for c in several if c not in auxiliary]
    if any(n[c] > MOST_POINTS for c in axes):
        raise InconsistentDimensionsError(f"an axis of over {MOST_POINTS} points: {[c for c in axes if n[c] > MOST_POINTS]}")
    return axes, [c for c in several if c in auxiliary]


def grid_of(cells: DataFrame, variables: list[str], *, auxiliary: tuple[str, ...] | None = None) -> tuple[DataFrame, list[Axis]]:
    """The long form (cell, <axis>_i, <axis>, <axis>_lo, <axis>_hi, other coordinates, variables) and the axes of a table of cells.

    Bounds come from columns <axis>_lo and <axis>_hi, if they are there. Cells with a missing coordinate go; cells that are not there
    stay away. Two cells at one place are an error: files that overlap, or coordinates that are no axes.
    """
    coords = coordinates(cells)
    cells = cells.where(" AND ".join(f"`{c}` IS NOT NULL" for c in coords)) if coords else cells
    names, other = dimensions(cells, auxiliary)
    if not names:
        raise InconsistentDimensionsError("no coordinate has more than one value")
    axes = []
    for c in names:
        stored = {f"{c}_lo", f"{c}_hi"} <= set(cells.columns)
        own = cells.groupBy(c).agg(*([F.min(f"{c}_lo").alias("lo"), F.max(f"{c}_hi").alias("hi")] if stored else [F.count("*")])).orderBy(c).collect()  # an axis
        axes.append(find_axis(c, [float(r[c]) for r in own], [(r.lo, r.hi) for r in own] if stored else None))
    spark = cells.sparkSession
    scalars = [c for c in coords if c not in names and c not in other]
    out = cells.select(*names, *other, *scalars, *variables)
    for a in axes:
        table = spark.createDataFrame([(i, p, lo, hi) for i, (p, lo, hi) in enumerate(zip(a.points, a.lo, a.hi))], f"`{a.name}_i` int, `{a.name}` double, `{a.name}_lo` double, `{a.name}_hi` double")
        out = out.withColumn(a.name, F.col(a.name).cast("double")).join(F.broadcast(table), a.name)
    out = out.withColumn("cell", cell_number(axes, {a.name: F.col(f"{a.name}_i") for a in axes}))
    ids = [c for a in axes for c in (f"{a.name}_i", a.name, f"{a.name}_lo", f"{a.name}_hi")]
    twice = out.groupBy("cell").count().where("count > 1").limit(1).collect()
    if twice:
        raise InconsistentDimensionsError(f"two cells at one place (cell {twice[0].cell} of {[len(a) for a in axes]}): files overlap, or {names} are not all axes")
    return out.select("cell", *ids, *other, *scalars, *variables), axes


def merge(parts: list[DataFrame], variables: list[str], **options) -> tuple[DataFrame, list[Axis]]:
    """One grid of several files' cells. Axes are what the cells of all of them have, so a scalar that differs between files becomes an axis
    and axes are continued; files that overlap are an error."""
    whole = parts[0]
    for p in parts[1:]:
        if set(coordinates(p)) != set(coordinates(whole)):
            raise InconsistentDimensionsError(f"coordinates differ: {coordinates(whole)} and {coordinates(p)}")
        whole = whole.unionByName(p, allowMissingColumns=True)
    return grid_of(whole, variables, **options)


def is_full(axes: list[Axis], cells: int) -> bool:
    return cells >= LEAST_FULL * math.prod(map(len, axes))


__all__ = ["dimensions", "find_axis", "grid_of", "is_full", "merge", "regular_step"]
