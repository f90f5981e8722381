"""Linear and nearest interpolation from grids to points and to other grids."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import wrap_longitude
from .grid import Axis, rank_in, spine


def _wrapped(a: Axis) -> Axis:
    """A cyclic axis with its first point again at the end."""
    return Axis(a.name, (*a.points, a.points[0] + 360.0), (*a.lo, a.lo[0] + 360.0), (*a.hi, a.hi[0] + 360.0), cyclic=True) if a.cyclic else a


def _interval(df: DataFrame, a: Axis, x: str, i: str, u: str) -> DataFrame:
    """df with i, the lower index of the interval of column x, clamped to the axis, and u, how far x is between its ends; a point at an
    index belongs to the interval before it, if there is one."""
    p, n, X = a.points, len(a.points), F.col(x)
    if n == 1:
        return df.withColumns({i: F.when(X.isNotNull(), F.lit(0)), u: F.when(X.isNotNull(), F.lit(0.0))})
    step = (p[-1] - p[0]) / (n - 1)
    if all(p[0] + k * step == v for k, v in enumerate(p)):
        s, d = F.lit(p[0]), F.lit(step)
        df = df.withColumn(i, F.least(F.greatest(F.ceil((X - s) / d).cast("int") - 1, F.lit(0)), F.lit(n - 2)))
        df = df.withColumns({"_a": s + F.col(i) * d, "_b": s + (F.col(i) + 1) * d})
    else:
        df = rank_in(df, p[:-1], x, i, right=False, carry={"_a": p[:-1], "_b": p[1:]})
        df = df.withColumn(i, F.greatest(F.col(i) - 1, F.lit(0)))
    return df.withColumn(u, (X - F.col("_a")) / (F.col("_b") - F.col("_a"))).drop("_a", "_b")


def bundles(grid: DataFrame, variables: list[str], axes: list[Axis], extra_dims: list[str] = ()) -> DataFrame:
    """One row for each interval of the axes and value of extra_dims: _i_<axis>, its lower index, and for each variable the array of its
    2^d corners, the first axis varying slowest. The grid's cells are what is repeated and grouped, never samples."""
    both = [a for a in axes if len(a) > 1]
    out = grid.select(*[f"{a.name}_i" for a in axes], *extra_dims, *variables)
    corner = F.lit(0)
    for a in axes:
        i, n = F.col(f"{a.name}_i"), len(a)
        if n == 1:
            out = out.withColumn(f"_i_{a.name}", i.cast("int"))
            continue
        # A cell is the lower corner of its own interval and the upper one of that before.
        out = out.withColumn(f"_k_{a.name}", F.explode(F.array(F.lit(0), F.lit(1))))
        k = F.col(f"_k_{a.name}")
        out = out.withColumn(f"_i_{a.name}", (F.pmod(i - k, F.lit(n)) if a.cyclic else i - k).cast("int"))
        corner = corner * 2 + k
    out = out.withColumn("_corner", corner)
    arrays = [F.array(*[F.max(F.when(F.col("_corner") == c, F.col(v))) for c in range(2 ** len(both))]).alias(f"_v_{v}") for v in variables]
    return out.groupBy(*[f"_i_{a.name}" for a in axes], *extra_dims).agg(*arrays)


def onto_points(samples: DataFrame, grid: DataFrame, variables: list[str], axes: list[Axis], how: str = "lin", *, key: str = "sample_id", extrapolate: bool = False, extra_dims: list[str] = (), missing_sample: str | None = None) -> DataFrame:
    """A grid's variables at sample points: `lin` or `nn`. Every sample is returned, with NULL outside the grid.

    grid: long form with <axis>_i and the variables; every axis must be a column of samples. A NULL corner makes the result NULL even
    with weight 0. extra_dims: further dimensions of grid, kept as columns. Longitude of a cyclic axis wraps. Samples meet the grid in one
    equi-join on the numbers of intervals (lin) or of the nearest cells (nn), and are not grouped; so key, a column that names a sample,
    need not be unique.
    """
    lacking = [a.name for a in axes if a.name not in samples.columns]
    if lacking:
        raise ValueError(f"samples lack {lacking}; every dimension of the grid must be matched")
    if how not in ("lin", "nn"):
        raise ValueError(f"how is lin or nn, not {how!r}")
    out = samples.drop(*[v for v in variables if v in samples.columns], *extra_dims)
    kept, inside = out.columns, F.lit(True) if missing_sample is None else F.col(missing_sample).isNotNull()
    for a in axes:
        x, w = F.col(a.name).cast("double"), _wrapped(a)
        out = out.withColumn(f"_x_{a.name}", wrap_longitude(x, w.points[0]) if a.cyclic else x)
        out = _interval(out, w, f"_x_{a.name}", f"_i_{a.name}", f"_u_{a.name}")
        x = F.col(f"_x_{a.name}")
        inside = inside & (x.isNotNull() if extrapolate else (x >= w.points[0]) & (x <= w.points[-1]))
    ids, several = [f"_i_{a.name}" for a in axes], [a for a in axes if len(a) > 1]
    if how == "nn":
        for a in several:
            i = F.col(f"_i_{a.name}") + (~(F.col(f"_u_{a.name}") <= 0.5)).cast("int")
            out = out.withColumn(f"_i_{a.name}", i % len(a) if a.cyclic else i)
        cells = grid.select(*[F.col(f"{a.name}_i").cast("int").alias(f"_i_{a.name}") for a in axes], *extra_dims, *[F.col(v).alias(f"_v_{v}") for v in variables])
    else:
        cells = bundles(grid, variables, axes, extra_dims)
    # Samples outside have no interval, and stay as a left join's unmatched rows.
    out = out.withColumns({i: F.when(inside, F.col(i)) for i in ids}).join(cells, ids, "left")
    if how == "nn" or not several:
        found = [(F.col(f"_v_{v}") if how == "nn" else F.col(f"_v_{v}")[0]).alias(v) for v in variables]
    else:
        weights = [F.lit(1.0)]
        for a in several:
            u = F.col(f"_u_{a.name}")
            weights = [w * x for w in weights for x in (1 - u, u)]
        found = [reduce(add, [w * F.col(f"_v_{v}")[c] for c, w in enumerate(weights)]).alias(v) for v in variables]
    return out.select(*kept, *extra_dims, *found)


def onto_grid(grid: DataFrame, variables: list[str], axes: list[Axis], target: list[Axis], how: str = "lin", *, extrapolate: bool = False, extra_dims: list[str] = (), missing_grid: DataFrame | None = None) -> DataFrame:
    """A grid on another grid's axes: target axes that it lacks are dropped, and its own further dimensions stay, last."""
    names = {a.name for a in target}
    used, own = [a for a in target if a.name in {x.name for x in axes}], [a for a in axes if a.name in names]
    cells = spine(grid.sparkSession, used)
    ids = cells.select("cell", *[a.name for a in used])
    out = onto_points(ids, grid, variables, own, how, key="cell", extrapolate=extrapolate, extra_dims=list(extra_dims))
    out = cells.join(out.select("cell", *extra_dims, *variables), "cell")
    if missing_grid is not None:
        out = out.join(missing_grid.select("cell", "missing"), "cell", "left").withColumns({v: F.when(~F.coalesce("missing", F.lit(False)), F.col(v)) for v in variables}).drop("missing")
    return out


def onto_points_hybrid(samples: DataFrame, grid: DataFrame, variables: list[str], axes: list[Axis], *, level: str, vertical: str, at: str, how: str = "lin", key: str = "sample_id", extrapolate: bool = False) -> DataFrame:
    """Interpolation where the vertical coordinate is itself a field: `vertical` (of grid) along dimension `level`, sought at samples' `at`.

    The column of the vertical coordinate is interpolated horizontally at each sample, then the level is located in it.
    """
    column = onto_points(samples.select(key, *[a.name for a in axes]), grid, [vertical, *variables], axes, how, key=key, extra_dims=[level])
    rows = F.array_sort(F.collect_list(F.struct(level, vertical, *variables)))  # one column of the grid
    column = column.where(F.col(level).isNotNull()).groupBy(key).agg(rows.alias("_c")).join(samples.select(key, F.col(at).alias("_x")), key)
    n = F.size("_c")
    # Heights rise with the level and pressures may fall; either way the column is read upwards in its own value.
    column = column.withColumn("_c", F.array_sort(F.transform("_c", lambda r: F.struct(r[vertical].alias("z"), r.alias("r")))))
    i = F.least(F.greatest(F.size(F.filter("_c", lambda r: r["z"] < F.col("_x"))) - 1, F.lit(0)), n - 2)
    column = column.where(n >= 2).withColumn("_i", i)
    z = lambda k: F.element_at("_c", F.col("_i") + k)["z"]
    u = (F.col("_x") - z(1)) / (z(2) - z(1))
    inside = F.lit(True) if extrapolate else (F.col("_x") >= F.element_at("_c", 1)["z"]) & (F.col("_x") <= F.element_at("_c", -1)["z"])
    cols = []
    for v in variables:
        a, b = F.element_at("_c", F.col("_i") + 1)["r"][v], F.element_at("_c", F.col("_i") + 2)["r"][v]
        cols.append(F.when(inside, F.when(u <= 0.5, a).otherwise(b) if how == "nn" else a * (1 - u) + b * u).alias(v))
    return samples.drop(*[v for v in variables if v in samples.columns]).join(column.select(key, *cols), key, "left")
