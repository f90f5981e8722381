"""What figures show, as tables; drawing them is left to whoever reads these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidCommandLineOptionError
from ..functions.names import coordinates
from . import stats
from .grid import Axis

#: Days from 1600-01-01 to 1970-01-01, from which figures count days.
DAYS_TO_1970 = 135_140.0
LEVELS = 7


def points(df: DataFrame, variable: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """x, y and v of every present point: for a line or scatter plot x is a coordinate (time, if there is one) and y the variable; with
    y given, or two_dimensional, both are coordinates and v is the colour. Times are days since 1970."""
    x = x or ("time" if "time" in df.columns else next(iter(coordinates(df)), None))
    if x is None:
        raise InvalidCommandLineOptionError("a coordinate is needed to plot against")
    shown = lambda c: F.col(c) - DAYS_TO_1970 if c == "time" else F.col(c)
    v = F.col(variable).cast("double")
    return df.where(F.col(variable).isNotNull()).select(shown(x).alias("x"), (shown(y) if y else v).alias("y"), v.alias("v"))


def line(df: DataFrame, variable: str, x: str | None = None) -> DataFrame:
    """The points of a line, in order of x."""
    return points(df, variable, x).select("x", "y").orderBy("x")


def scatter2d(df: DataFrame, variable: str) -> DataFrame:
    return points(df, variable, "longitude", "latitude")


def comparative_scatter(df: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """The pairs that are both present, and the two ends of the line y = x through their common range."""
    pairs = stats.common(df, x, y)
    ends = pairs.agg(F.least(F.min("x"), F.min("y")).alias("a"), F.greatest(F.max("x"), F.max("y")).alias("b"))
    return pairs, ends.select(F.explode(F.array("a", "b")).alias("x")).where("x IS NOT NULL").select("x", F.col("x").alias("y"))


def mesh(df: DataFrame, variable: str, axes: list[Axis]) -> DataFrame:
    """A grid's cells as x, y, v with their edges; of a cyclic longitude the first column is there again at the end, 360 degrees on.

    axes: the two that are shown, x first."""
    ax, ay = axes
    side = lambda a, n: [F.col(a.name).alias(n), *(F.col(c).alias(f"{n}{s}") for s in ("_lo", "_hi") if (c := f"{a.name}{s}") in df.columns)]
    cells = df.select(F.col(f"{ax.name}_i").alias("x_i"), F.col(f"{ay.name}_i").alias("y_i"), *side(ax, "x"), *side(ay, "y"), F.col(variable).alias("v"))
    if not (ax.cyclic or ax.name == "longitude" and ax.lo[0] + 360 == ax.hi[-1]):
        return cells
    again = cells.where("x_i = 0").withColumn("x_i", F.lit(len(ax)).cast("int"))
    return cells.unionByName(again.withColumns({c: F.col(c) + 360.0 for c in ("x", "x_lo", "x_hi") if c in cells.columns}))


def contour_levels(df: DataFrame, variable: str, n: int = LEVELS) -> DataFrame:
    """n levels from the least to the greatest value."""
    ends = df.agg(F.min(variable).cast("double").alias("a"), F.max(variable).cast("double").alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("level"), "a", "b").select("level", (F.col("a") + (F.col("b") - F.col("a")) * F.col("level") / max(n - 1, 1)).alias("v"))


def figure(kind: str, df: DataFrame, variables: list[str], axes: list[Axis] = ()) -> dict[str, DataFrame]:
    """The tables of a figure by name. kind: line, scatter, scatter2d, comparativescatter, histogram, histogram2d, taylor, heatmap, contour
    or contourf (these three of a grid)."""
    v = variables[0]
    if kind in ("heatmap", "contour", "contourf"):
        shown = sorted(axes, key=lambda a: ["longitude", "time", "latitude", "altitude", "air_pressure"].index(a.name))
        if len(shown) != 2:
            raise InvalidCommandLineOptionError(f"{kind} shows a grid of two dimensions, not of {len(shown)}")
        out = {"mesh": mesh(df, v, shown)}
        return out if kind == "heatmap" else out | {"levels": contour_levels(df, v)}
    if kind in ("comparativescatter", "histogram2d") and len(variables) != 2:
        raise InvalidCommandLineOptionError(f"{kind} shows two variables")
    if kind == "comparativescatter":
        return dict(zip(("points", "line"), comparative_scatter(df, *variables)))
    made = {
        "line": lambda: {n: line(df, n) for n in variables}, "scatter": lambda: {n: points(df, n).select("x", "y") for n in variables}, "scatter2d": lambda: {"points": scatter2d(df, v)},
        "histogram": lambda: {n: stats.histogram(df, n) for n in variables}, "histogram2d": lambda: {"counts": stats.histogram2d(df, *variables)}, "taylor": lambda: {"points": stats.taylor(df, list(variables))},
    }
    if kind not in made:
        raise InvalidCommandLineOptionError(f"no plot {kind!r}")
    return made[kind]()
