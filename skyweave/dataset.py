"""A thin wrapper that keeps a DataFrame with what is known of it: its variables and, for a grid, its axes."""

from __future__ import annotations

import datetime as dt
import fnmatch
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CoordinateNotFoundError, InconsistentDimensionsError, InvalidDataTypeError, InvalidVariableError
from .functions.geo import wrap_longitude
from .functions.names import coordinates, select_variables
from .functions.time import to_timestamp
from .operators import aggregate as ag
from .operators import collocate as co
from .operators import evaluate as ev
from .operators import interpolate as ip
from .operators import plotdata
from .operators import stats as st
from .operators.grid import Axis
from .operators.subset import subset, subset_grid
from .sources import grids, products, sinks


@dataclass(frozen=True)
class Dataset:
    """Points, or a grid in long form if it has axes. Every method returns a new Dataset and runs nothing that need not run."""

    df: DataFrame
    variables: tuple[str, ...]
    axes: tuple[Axis, ...] = ()
    history: str = field(default="", compare=False)

    @property
    def gridded(self) -> bool:
        return bool(self.axes)

    @property
    def coords(self) -> list[str]:
        return coordinates(self.df)

    def _with(self, df: DataFrame, note: str, variables=None, axes=None) -> "Dataset":
        line = f"{dt.datetime.now(dt.timezone.utc):%Y-%m-%dT%H:%M:%SZ} {note}"
        return replace(self, df=df, variables=tuple(self.variables if variables is None else variables), axes=tuple(self.axes if axes is None else axes), history=f"{self.history}\n{line}".strip())

    def subset(self, **limits) -> "Dataset":
        df = subset_grid(self.df, list(self.variables), **limits) if self.gridded else subset(self.df, **limits)
        return self._with(df, f"subset {limits}")

    def aggregate(self, how: str = "moments", **grid) -> "Dataset":
        """Points onto a new grid. Grids are collapsed, not aggregated."""
        if self.gridded:
            raise InvalidDataTypeError("a grid is collapsed")
        axes = ag.resolve_grid(self.df, grid)
        out = ag.aggregate(self.df, list(self.variables), how, {a.name: (a.lo[0], a.hi[-1], a.step or a.hi[-1] - a.lo[0]) for a in axes}, coords=self.coords)
        return self._with(out, f"aggregate {how} {grid}", ag.kernels.output_names(how, list(self.variables)), axes)

    def collapsed(self, *dims: str, how: str = "moments") -> "Dataset":
        if not self.gridded:
            raise InvalidDataTypeError("only a grid is collapsed")
        names = [a.name for a in self.axes]
        unknown = set(dims) - set(names)
        if unknown:
            raise InconsistentDimensionsError(f"no dimension {sorted(unknown)}")
        keep = [a for a in self.axes if a.name not in dims]
        weight = None
        if "latitude" in dims and "latitude_lo" in self.df.columns:
            lon = [F.col("longitude_lo"), F.col("longitude_hi")] if "longitude_lo" in self.df.columns else [None, None]
            weight = ag.area_weight(F.col("latitude_lo"), F.col("latitude_hi"), *lon)
        keys = [c for a in keep for c in (f"{a.name}_i", a.name, f"{a.name}_lo", f"{a.name}_hi") if c in self.df.columns]
        out = ag.collapse(self.df, list(self.variables), [*keys, *[f"{d}_i" for d in dims]], [f"{d}_i" for d in dims], how, weight=weight)
        return self._with(out, f"collapse {dims} {how}", [c for c in out.columns if c not in keys], keep)

    def copy(self) -> "Dataset":
        return replace(self)

    def __getitem__(self, rows: slice) -> "Dataset":
        """Rows by position: those whose row_id lies in start:stop, as a table has no order of its own."""
        if "row_id" not in self.df.columns:
            raise InvalidDataTypeError("a positional slice needs a column row_id")
        if rows.step not in (None, 1):
            raise InvalidDataTypeError("a positional slice has no step")
        df = self.df
        for bound, test in ((rows.start, F.col("row_id").__ge__), (rows.stop, F.col("row_id").__lt__)):
            df = df if bound is None else df.where(test(bound))
        return self._with(df, f"rows {rows.start}:{rows.stop}")

    def with_same_coordinates(self, name: str, values: Column, units: str = "1", **attributes) -> "Dataset":
        """A new variable alone, at the same points."""
        keep = [c for c in self.df.columns if c not in self.variables]
        return self._with(self.df.select(*keep, values.alias(name, metadata={"units": units, **attributes})), f"new variable {name}", [name])

    def figure(self, kind: str) -> dict[str, DataFrame]:
        """The tables that a plot of this kind shows."""
        return plotdata.figure(kind, self.df, list(self.variables), list(self.axes))

    def describe(self) -> DataFrame:
        return st.describe(self.df, list(self.variables))

    def sampled_from(self, data: "Dataset", how: str | None = None, kernel: str | None = None, *, key: str = "sample_id", missing_data_for_missing_sample: bool = False, **options) -> "Dataset":
        """data's variables at this dataset's points or cells: box, bin, lin or nn, by default what suits the two kinds."""
        lacking = [a.name for a in data.axes if not self.gridded and a.name not in self.df.columns]
        if lacking or not (self.gridded or self.coords):
            raise CoordinateNotFoundError(f"the sample has no {lacking or 'coordinates'}")
        if not self.gridded and key not in self.df.columns:
            return replace(self, df=self.df.withColumn(key, F.monotonically_increasing_id())).sampled_from(data, how, kernel, key=key, missing_data_for_missing_sample=missing_data_for_missing_sample, **options)
        how = how or {(False, False): "box", (False, True): "lin", (True, False): "bin", (True, True): "lin"}[self.gridded, data.gridded]
        missing = self.variables[0] if missing_data_for_missing_sample and self.variables else None
        values = list(data.variables)
        if data.gridded:
            if kernel:
                raise InvalidDataTypeError("interpolation takes no kernel")
            if self.gridded:
                mask = self.df.select("cell", F.col(missing).isNull().alias("missing")) if missing else None
                out = ip.onto_grid(data.df, values, list(data.axes), list(self.axes), how, missing_grid=mask, **options)
            else:
                out = ip.onto_points(self.df, data.df, values, list(data.axes), how, key=key, missing_sample=missing, **options)
            return self._with(out, f"sampled {values} by {how}", values)
        kernel = kernel or "moments"
        names = ag.kernels.output_names(kernel, values)
        if not self.gridded:
            if how != "box":
                raise InvalidDataTypeError(f"points are sampled from points by box, not {how!r}")
            out = co.box(self.df, data.df, values, kernel, key=key, missing_sample=missing, **options)
        elif how in ("bin", "cell"):
            mask = self.df.select("cell", F.col(missing).isNull().alias("missing")) if missing else None
            out = co.bin_onto(data.df, values, list(self.axes), kernel, missing_grid=mask, **options)
        else:
            out = co.box_onto_grid(data.df, values, list(self.axes), kernel, **options)
        return self._with(out, f"sampled {values} by {how} {kernel}", names)

    def collocated_onto(self, sample: "Dataset", how: str | None = None, kernel: str | None = None, **options) -> "Dataset":
        return sample.sampled_from(self, how, kernel, **options)

    def evaluate(self, expr: str, output: str = "calculated_variable", **options) -> "Dataset":
        return self._with(ev.evaluate(self.df, expr, output, **options), f"evaluate {expr}", [*self.variables, output])

    def stats(self, x: str, y: str) -> DataFrame:
        return st.stats(self.df, x, y)

    def info(self) -> DataFrame:
        return st.info(self.df, list(self.variables))

    def set_longitude_range(self, start: float) -> "Dataset":
        return self._with(self.df.withColumn("longitude", wrap_longitude(F.col("longitude"), start)), f"longitudes from {start}")

    def select(self, *variables: str) -> "Dataset":
        lacking = set(variables) - set(self.variables)
        if lacking:
            raise InvalidVariableError(f"no variable {sorted(lacking)}")
        return self._with(self.df.drop(*set(self.variables) - set(variables)), f"select {variables}", variables)

    def as_data_frame(self, time_index: bool = True):
        """As pandas, on the driver: for results that are small."""
        out = (self.df.withColumn("time", to_timestamp(F.col("time"))) if "time" in self.coords else self.df).toPandas()
        return out.set_index("time") if time_index and "time" in out else out

    def save_data(self, path: str, overwrite: bool = False) -> None:
        """Written as Parquet; with a warning first where the space may not do."""
        if (why := sinks.warn_of_space(self.df, path)) is not None:
            warnings.warn(why, ResourceWarning, stacklevel=2)
        df = sinks.annotate(self.df, {v: {"history": self.history} for v in self.variables if v in self.df.columns})
        sinks.save_grid(df, list(self.axes), path, overwrite=overwrite) if self.gridded else sinks.save(df, path, overwrite=overwrite)


def read_data_list(spark: SparkSession, paths, variables, product: str | None = None, aliases: list[str] | None = None) -> Dataset:
    """Points, or a grid: that which save_grid() wrote under the path, or the cells of files of a gridded product, merged."""
    found = products._paths(paths)
    if len(found) == 1 and product is None and (axes := sinks.axes_of(spark, found[0])):
        cells = spark.read.parquet(f"{found[0]}/cells")
        names = [n for p in ([variables] if isinstance(variables, str) else variables) for n in fnmatch.filter([c for c in cells.columns if c not in axis_columns(axes)], p)]
        if not names:
            raise InvalidVariableError(f"no variable matches {variables!r}")
        if aliases:
            cells = cells.withColumnsRenamed(dict(zip(names, aliases)))
        out = aliases or names
        return Dataset(cells.select(*[c for c in cells.columns if c in axis_columns(axes)], *out), tuple(out), tuple(axes))
    p = products.find_product(spark, found[0], product) if found else None
    if getattr(p, "gridded", False):
        cells = p.scan(spark, found)
        ends = [f"{c}_{e}" for c in coordinates(cells) for e in ("lo", "hi") if f"{c}_{e}" in cells.columns]
        names = [c for c in select_variables(cells.drop(*ends), [variables] if isinstance(variables, str) else list(variables)).columns if c not in coordinates(cells)]
        cells = cells.select(*coordinates(cells), *ends, *[F.when(~F.isnan(c), F.col(c)).alias(c, metadata=cells.schema[c].metadata) if dict(cells.dtypes)[c] in ("double", "float") else F.col(c) for c in names])
        df, axes = grids.grid_of(cells, names)
        if grids.is_full(axes, df.count()):
            out = list(aliases or names)
            if len(out) != len(names):
                raise ValueError("as many aliases as variables are needed")
            return Dataset(df.withColumnsRenamed(dict(zip(names, out))), tuple(out), tuple(axes))
    df = products.read(spark, paths, variables, product=product, aliases=aliases)
    return Dataset(df, tuple(c for c in df.columns if c not in coordinates(df)))


def read_data(spark: SparkSession, paths, variable: str, product: str | None = None) -> Dataset:
    out = read_data_list(spark, paths, variable, product)
    if len(out.variables) != 1:
        raise InvalidVariableError(f"{variable!r} means several variables")
    return out


def axis_columns(axes) -> list[str]:
    return ["cell", *[f"{a.name}{s}" for a in axes for s in ("_i", "", "_lo", "_hi")]]


def get_variables(spark: SparkSession, paths, product: str | None = None, type: str | None = None) -> list[str]:
    return products.variables(spark, paths, product=product, type=type)
