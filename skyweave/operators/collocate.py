"""Collocation of points: distance boxes, nearest neighbours, and bins of a given grid.

A distance join is an equi-join on cells. Data rows get one cell; sample rows are repeated for the cells that they reach. Rows of
latitude have as many cells as fit round their circle, so a sample reaches a handful of cells at any latitude, poles included.
Each pair meets in one cell; the exact separation tests are conditions of the join.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidCommandLineOptionError
from ..functions.geo import EARTH_RADIUS, haversine, pressure_ratio, wrap_longitude, wrap_start
from ..functions.names import STANDARD
from ..scratch import save
from . import kernels, tree
from .grid import Axis, cell_number, locate, spine


def fix_longitudes(sample: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """All longitudes in [-180, 180) if the sample has a negative one, else in [0, 360)."""
    start = wrap_start(sample.agg(F.min("longitude")).first()[0]) if "longitude" in sample.columns else 0.0
    return [d.withColumn("longitude", wrap_longitude(F.col("longitude"), start)) if "longitude" in d.columns else d for d in (sample, *others)]


def _rows_of(h_km: float) -> tuple[float, int]:
    """Height in degrees and number of the rows of latitude."""
    height = max(math.degrees(h_km / EARTH_RADIUS) * (1 + 1e-9), 1e-3)
    n = max(1, math.floor(180 / height))
    return 180 / n, n


def _columns_in(row: Column, height: float) -> Column:
    """How many cells a row has: as wide as it is high at its edge nearest the equator, or less wide towards a pole."""
    south = row * F.lit(height) - 90.0
    nearest = F.least(F.abs(south), F.abs(south + height))
    nearest = F.when((south < 0) & (south + height > 0), F.lit(0.0)).otherwise(nearest)
    return F.greatest(F.floor(F.lit(360.0 / height) * F.cos(F.radians(nearest))), F.lit(1)).cast("long")


def _row(lat: Column, height: float, n: int) -> Column:
    return F.least(F.greatest(F.floor((lat + 90.0) / height), F.lit(0)), F.lit(n - 1)).cast("long")


def _horizontal_keys(data: DataFrame, sample: DataFrame, h_km: float) -> tuple[DataFrame, DataFrame]:
    height, n = _rows_of(h_km)
    data = data.withColumn("_r", _row(F.col("latitude"), height, n))
    data = data.withColumn("_c", F.least(F.floor(F.pmod("longitude", F.lit(360.0)) / 360.0 * _columns_in(F.col("_r"), height)).cast("long"), _columns_in(F.col("_r"), height) - 1))
    lat, lon, d = F.col("s_latitude"), F.pmod(F.col("s_longitude"), F.lit(360.0)), h_km / EARTH_RADIUS
    r = _row(lat, height, n)
    sample = sample.withColumn("_r", F.explode(F.sequence(F.greatest(r - 1, F.lit(0)), F.least(r + 1, F.lit(n - 1)))))
    cells = _columns_in(F.col("_r"), height)
    if d >= math.pi / 2:
        full, reach = F.lit(True), F.lit(180.0)
    else:
        full = F.abs(F.radians(lat)) + d >= math.pi / 2 - 1e-9
        reach = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(d)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))))) * (1 + 1e-9) + 1e-9
    first, last = F.floor((lon - reach) / 360.0 * cells).cast("long"), F.floor((lon + reach) / 360.0 * cells).cast("long")
    whole = full | (last - first + 1 >= cells)
    ids = F.when(whole, F.sequence(F.lit(0).cast("long"), cells - 1)).otherwise(F.transform(F.sequence(F.when(whole, F.lit(0)).otherwise(first), F.when(whole, F.lit(0)).otherwise(last)), lambda i: F.pmod(i, cells)))
    return data, sample.withColumn("_c", F.explode(ids))


def pairs(sample: DataFrame, data: DataFrame, *, h_sep: float | None = None, a_sep: float | None = None, p_sep: float | None = None, t_sep: float | None = None, strict: bool = False, where: Column | None = None, salts: int = 1) -> DataFrame:
    """Sample rows (columns named s_<name>) with the data rows within all separations: haversine <= h_sep km (strict: <), altitude and
    time differences < a_sep and t_sep, pressure ratio < p_sep. At least one is needed. where: a further condition over s_<name> and
    <name>. salts: data of one cell are dealt to so many tasks, each with all of the cell's samples; for data from a few places, beyond
    what adaptive execution splits."""
    s = sample.select([F.col(c).alias(f"s_{c}") for c in sample.columns])
    tests, keys = [], []
    if salts > 1:
        data = data.withColumn("_salt", F.pmod(F.xxhash64(*data.columns), F.lit(salts)))
        s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        salted = ["_salt"]
    else:
        salted = []
    if h_sep is not None:
        data, s = _horizontal_keys(data, s, h_sep)
        keys += ["_r", "_c"]
        d = haversine(F.col("s_latitude"), F.col("s_longitude"), F.col("latitude"), F.col("longitude"))
        tests.append(d < h_sep if strict else d <= h_sep)
    steps = []
    if t_sep is not None:
        tests.append(F.abs(F.col("time") - F.col("s_time")) < t_sep)
        steps.append(("_t", lambda p: F.col(f"{p}time"), t_sep))
    if a_sep is not None:
        tests.append(F.abs(F.col("altitude") - F.col("s_altitude")) < a_sep)
        steps.append(("_a", lambda p: F.col(f"{p}altitude"), a_sep))
    if p_sep is not None:
        tests.append(pressure_ratio(F.col("air_pressure"), F.col("s_air_pressure")) < p_sep)
        if p_sep > 1:
            steps.append(("_p", lambda p: F.ln(F.col(f"{p}air_pressure")), math.log(p_sep)))
    # One vertical or temporal key beside the horizontal one; the others are tests alone.
    for key, x, step in steps[:1] if h_sep is not None else steps[:2]:
        data = data.withColumn(key, F.floor(x("") / step))
        s = s.withColumn(key, F.explode(F.sequence(F.floor(x("s_") / step) - 1, F.floor(x("s_") / step) + 1)))
        keys.append(key)
    if not tests:
        raise ValueError("no separation given")
    if not keys:  # a pressure ratio of 1 or less is never undercut
        return s.join(data.limit(0)).drop(*salted)
    keys += salted
    on = tests[0] if where is None else tests[0] & where
    for t in tests[1:]:
        on = on & t
    left, right = s.alias("_s"), data.alias("_d")
    for k in keys:
        on = on & (F.col(f"_s.{k}") == F.col(f"_d.{k}"))
    return left.join(right, on).drop(*keys)


@dataclass(frozen=True)
class PythonKernel:
    """fn(sample: dict, matches: pandas.DataFrame, variable) gives a value for each suffix of the output's name, or one value. With batch it is
    fn(samples, data: pandas.DataFrame, near: a row a sample and a column a row of data, variable) and gives an array of a value a sample,
    or one for each suffix; it is called once for a leaf of samples. A sample's matches are in one task."""

    fn: Callable[..., object]
    suffixes: tuple[str, ...] = ("",)
    batch: bool = False

    def outputs(self, variables: list[str]) -> list[str]:
        return [f"{v}{s}" for v in variables for s in self.suffixes]

    def schema(self, key: str, kind: str, variables: list[str]) -> str:
        return f"`{key}` {kind}, " + ", ".join(f"`{n}` double" for n in self.outputs(variables))

    def call(self, samples: pd.DataFrame, data: pd.DataFrame, near: np.ndarray, key: str, variables: list[str]) -> pd.DataFrame:
        """A row for each sample that is near any data; without one no kernel is called."""
        met = near.any(1)
        samples, near = samples[met].reset_index(drop=True), near[met]
        out = {key: samples[key]}
        for v in variables:
            have = data[v].notna().to_numpy()
            if self.batch:
                got = self.fn(samples, data, near & have, v) if len(samples) else []
            else:
                rows = [self.fn(r, data[m & have], v) for r, m in zip(samples.to_dict("records"), near)]
                got = list(zip(*rows)) if len(self.suffixes) > 1 and rows else rows
            for s, x in zip(self.suffixes, got if len(self.suffixes) > 1 and len(samples) else [got] * len(self.suffixes)):
                out[f"{v}{s}"] = pd.Series(x, dtype=float)
        return pd.DataFrame(out)

    def apply(self, near: DataFrame, key: str, variables: list[str]) -> DataFrame:
        """Of pairs: a sample's are one group."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own = [c for c in pdf.columns if c.startswith("s_")]
            sample = pdf[own].iloc[:1].rename(columns=lambda c: c[2:])
            return self.call(sample, pdf.drop(columns=own), np.ones((1, len(pdf)), bool), key, variables)

        return near.groupBy(f"s_{key}").applyInPandas(run, self.schema(key, near.schema[f"s_{key}"].dataType.simpleString(), variables))


def _medians(samples: pd.DataFrame, data: pd.DataFrame, near: np.ndarray, v: str) -> np.ndarray:
    x, out = data[v].to_numpy(float), np.full(len(near), np.nan)
    for i, m in enumerate(near):
        if m.any():
            out[i] = np.median(x[m])
    return out


MEDIAN = PythonKernel(_medians, batch=True)


def box(sample: DataFrame, data: DataFrame, variables: list[str], kernel: str = "moments", *, key: str = "sample_id", row_id: str | None = None, h_sep: float | None = None, a_sep: float | None = None, p_sep: float | None = None, t_sep: float | None = None, missing_sample: str | None = None, fill_value: float | None = None, user_kernels: dict | None = None, strict: bool = False, where: Column | None = None, salts: int = 1) -> DataFrame:
    """Every sample row with the kernel of the data within its separations; NULL where there are none.

    Rows of data whose variables are all missing are left out. key: a unique column of sample. row_id: breaks ties of nearest kernels,
    the smallest wins. missing_sample: a column of sample whose NULL forces NULL outputs. Without a separation every data row is within.
    where: a user's constraint, beside a separation. user_kernels: by name, functions of a variable that give Columns, or PythonKernels.
    """
    own = (user_kernels or {}).get(kernel)
    if (where is not None or isinstance(own, PythonKernel)) and h_sep is a_sep is p_sep is t_sep is None:
        raise InvalidCommandLineOptionError("a constraint, and a kernel that sees the sample, need a separation to join by")
    if kernel == "nn_horizontal_only":
        return nearest(sample, data, variables, key=key, row_id=row_id, missing_sample=missing_sample)
    if kernel in kernels.NEAREST and h_sep is a_sep is p_sep is t_sep is None:
        if kernels.NEAREST[kernel] == "h":
            out = nearest(sample, data, variables, key=key, row_id=row_id, missing_sample=missing_sample)
        else:
            out = nearest_along(sample, data, variables, kernels.NEAREST[kernel], key=key, row_id=row_id, missing_sample=missing_sample)
        return out.fillna(fill_value, variables) if fill_value is not None else out
    sample, data = fix_longitudes(sample, data)
    data = data.where(" OR ".join(f"`{v}` IS NOT NULL" for v in variables))
    outs = own.outputs(variables) if isinstance(own, PythonKernel) else kernels.output_names(kernel, variables)
    side = sample if missing_sample is None else sample.where(F.col(missing_sample).isNotNull())
    use = [c for c in STANDARD if c in sample.columns and c in data.columns]
    s = side.select(key, *use)
    if h_sep is a_sep is p_sep is t_sep is None:
        found = s.select(key).crossJoin(F.broadcast(data.agg(*kernels.data_only(kernel, variables, user_kernels))))  # one row
    elif where is None and own is None and (p_sep is None or p_sep > 1) and (kernel in kernels.FROM_SUMS or kernel in ("gmean", "hmean") or kernel in kernels.NEAREST):
        found = _by_tree(s, data, variables, kernel, key, row_id, tree.Limits(h_sep, a_sep, p_sep, t_sep, strict))
    elif where is None and (isinstance(own, PythonKernel) or own is None and kernel == "median") and (p_sep is None or p_sep > 1):
        found = _by_leaf(s, data.select(*dict.fromkeys([*use, *variables])), variables, own or MEDIAN, key, tree.Limits(h_sep, a_sep, p_sep, t_sep, strict))
    else:
        theirs = data.select(*dict.fromkeys([*use, *variables, *([row_id] if row_id else [])]))
        if p_sep is None or p_sep > 1:
            near = tree.paired(s, theirs, tree.Limits(h_sep, a_sep, p_sep, t_sep, strict))
            near = near if where is None else near.where(where)
        else:
            near = pairs(s, theirs, h_sep=h_sep, a_sep=a_sep, p_sep=p_sep, t_sep=t_sep, strict=strict, where=where, salts=salts)
        if kernel in kernels.NEAREST:
            far = {"h": lambda: haversine(F.col("s_latitude"), F.col("s_longitude"), F.col("latitude"), F.col("longitude")), "a": lambda: F.abs(F.col("altitude") - F.col("s_altitude")), "p": lambda: pressure_ratio(F.col("air_pressure"), F.col("s_air_pressure")), "t": lambda: F.abs(F.col("time") - F.col("s_time"))}[kernels.NEAREST[kernel]]()
            order = F.struct(far, F.col(row_id) if row_id else F.lit(0))
            cols = [F.min_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in variables]
        elif not isinstance(own, PythonKernel):
            cols = kernels.data_only(kernel, variables, user_kernels)
            outs += [n for n in near.groupBy().agg(*cols).columns if n not in outs]
        found = own.apply(near, key, variables) if isinstance(own, PythonKernel) else near.groupBy(F.col(f"s_{key}").alias(key)).agg(*cols)
    out = sample.drop(*[o for o in outs if o in sample.columns]).join(found, key, "left")
    return out.fillna(fill_value, outs) if fill_value is not None else out


def _by_tree(sample: DataFrame, data: DataFrame, variables: list[str], kernel: str, key: str, row_id: str | None, limits: tree.Limits) -> DataFrame:
    """(key, the kernel's columns) of the samples that have data within the limits, by trees of both."""
    if kernel in kernels.NEAREST:
        found = None
        for v in variables:
            near, _ = tree.nearest_in(sample, data, v, key, row_id, kernels.NEAREST[kernel], limits)
            own = near.groupBy(key).agg(F.min_by(v, F.struct("_far", "_rid")).alias(v))  # a row for each 64 leaves that a sample met
            found = own if found is None else found.join(own, key, "full")
        return found
    if kernel in ("gmean", "hmean"):
        term = (lambda v: F.when(F.col(v) > 0, F.ln(v))) if kernel == "gmean" else (lambda v: F.try_divide(F.lit(1.0), F.col(v).cast("double")))
        terms = {f"_t_{v}": term(v) for v in variables}
        sums = tree.box_sums(sample, data.withColumns(terms), [*variables, *terms], key, limits)
        near = sums.rows.groupBy(key).agg(*tree.merged([*variables, *terms]))
        return near.select(key, *[kernels.from_terms(kernel, v, sums.middle[f"_t_{v}"]) for v in variables])
    sums = tree.box_sums(sample, data, variables, key, limits, centred=kernel not in ("mean", "sum", "RMS"), extremes=kernel in ("min", "max"))
    return sums.rows.groupBy(key).agg(*tree.merged(variables)).select(key, *[c for v in variables for c in kernels.from_sums(kernel, v, sums.middle[v])])


def _by_leaf(sample: DataFrame, data: DataFrame, variables: list[str], kernel: PythonKernel, key: str, limits: tree.Limits) -> DataFrame:
    """(key, the kernel's columns): a call a leaf of samples; samples that meet very many leaves are taken one by one, by their pairs."""
    data = data.withColumns({v: F.col(v).cast("double") for v in variables}) if kernel is MEDIAN else data
    call = lambda x, y, near: kernel.call(x, y, near, key, variables)
    rows, rest, _ = tree.by_leaf(sample, data, limits, call, kernel.schema(key, dict(sample.dtypes)[key], variables))
    many = kernels.medians(rest.withColumnRenamed(f"s_{key}", key), [key], variables) if kernel is MEDIAN else kernel.apply(rest, key, variables)
    return rows.unionByName(many)


def nearest(sample: DataFrame, data: DataFrame, variables: list[str], *, key: str = "sample_id", row_id: str | None = None, missing_sample: str | None = None) -> DataFrame:
    """The horizontally nearest present value of each variable for each sample, however far: samples open those leaves of data alone that no
    other leaf is nearer than."""
    sample, data = fix_longitudes(sample, data)
    side = sample if missing_sample is None else sample.where(F.col(missing_sample).isNotNull())
    rid = F.col(row_id) if row_id else F.lit(0).cast("long")
    out = sample.drop(*[v for v in variables if v in sample.columns])
    for v in variables:
        # Of rows at one place only the first counts, so data from a few stations are a few rows.
        first = data.where(F.col(v).isNotNull()).groupBy("latitude", "longitude").agg(F.min_by(v, rid).alias(v), F.min(rid).alias("_first"))
        near, _ = tree.nearest_in(side, first, v, key, "_first", "h")
        out = out.join(near.groupBy(key).agg(F.min_by(v, F.struct("_far", "_rid")).alias(v)), key, "left")
    return out


#: How far apart two values of a vertical coordinate or of time are, and its column, by the letter of a nearest kernel.
ALONG = {"a": ("altitude", lambda x, y: F.abs(x - y)), "p": ("air_pressure", pressure_ratio), "t": ("time", lambda x, y: F.abs(x - y))}


def nearest_along(sample: DataFrame, data: DataFrame, variables: list[str], by: str, *, key: str = "sample_id", row_id: str | None = None, missing_sample: str | None = None) -> DataFrame:
    """The value of each variable that is nearest in altitude (a), pressure ratio (p) or time (t), however far; ties to the smallest row_id.

    Data are first reduced to one row for each value of the coordinate. These and the samples' values stand in one order, cut into
    ranges; the last before and the first after each sample are found within its range, or are a range's last or first, of which
    there is one row a range.
    """
    c, far = ALONG[by]
    side = sample if missing_sample is None else sample.where(F.col(missing_sample).isNotNull())
    asked = side.select(F.col(c).cast("double").alias("x")).where("x IS NOT NULL").distinct()
    out = sample.drop(*[v for v in variables if v in sample.columns])
    for v in variables:
        rid = F.col(row_id).cast("string" if dict(data.dtypes).get(row_id) == "string" else "long") if row_id else F.lit(0).cast("long")
        own = data.where(F.col(v).isNotNull() & F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("x")).agg(F.min(rid).alias("r"), F.min_by(v, rid).alias("v"))
        both = own.select("x", F.struct("x", "r", "v").alias("e")).unionByName(asked.select("x", F.lit(None).alias("e")), allowMissingColumns=True)
        parts = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both, _ = save(both.repartitionByRange(parts, "x").withColumn("b", F.spark_partition_id()))
        ends = both.where("e IS NOT NULL").groupBy("b").agg(F.max_by("e", "x").alias("last"), F.min_by("e", "x").alias("first"))
        ends = both.select("b").distinct().join(ends, "b", "left")  # a row a range
        # Frames that grow: one that shrinks is read again for each row.
        upto = lambda by, *way: F.last(by, True).over(Window.orderBy(*way).rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select("b", upto("last", "b").alias("earlier"), upto("first", F.desc("b")).alias("later"))
        within = Window.partitionBy("b")
        before, after = (F.last("e", True).over(within.orderBy(way).rangeBetween(Window.unboundedPreceding, 0)) for way in (F.asc("x"), F.desc("x")))
        met = both.withColumns({"before": before, "after": after}).where("e IS NULL").join(F.broadcast(ends), "b")
        ways = [F.coalesce("before", "earlier"), F.coalesce("after", "later")]
        best = F.array_min(F.filter(F.array(*[F.when(w.isNotNull(), F.struct(far(F.col("x"), w["x"]).alias("far"), w["r"].alias("r"), w["v"].alias("v"))) for w in ways]), lambda s: s.isNotNull()))
        out = out.join(met.select(F.col("x").alias("_x"), best["v"].alias(v)), F.col(c).cast("double") == F.col("_x"), "left").drop("_x")
    if missing_sample is not None:
        out = out.withColumns({v: F.when(F.col(missing_sample).isNotNull(), F.col(v)) for v in variables})
    return out


def bin_onto(data: DataFrame, variables: list[str], axes: list[Axis], kernel: str = "moments", *, missing_grid: DataFrame | None = None, row_id: str | None = None, user_kernels: dict | None = None) -> DataFrame:
    """The kernel of the data in each cell of a given grid, dense. Axes that data lacks are dropped; cells are half-open, and points in
    gaps between bounds are in none. missing_grid: (cell, missing) whose missing cells become NULL; it needs all axes in data.
    Nearest kernels refer to the cell's centre."""
    used = [a for a in axes if a.name in data.columns]
    if missing_grid is not None and len(used) < len(axes):
        raise InvalidCommandLineOptionError("a sample mask needs every coordinate of the sample in the data")
    if any(a.name == "longitude" for a in used):
        a = next(a for a in used if a.name == "longitude")
        data = data.withColumn("longitude", wrap_longitude(F.col("longitude"), a.lo[0] if a.hi[-1] > wrap_start(a.lo[0]) + 360 or a.lo[0] < -180 else wrap_start(a.lo[0])))
    cells = spine(data.sparkSession, used)
    binned, found = data, {a.name: f"_at_{a.name}" for a in used}
    for a in used:
        binned = locate(binned, a, found[a.name])
    binned = binned.withColumn("cell", cell_number(used, {n: F.col(c) for n, c in found.items()})).where("cell IS NOT NULL").drop(*found.values())
    if kernel in kernels.NEAREST:
        by = kernels.NEAREST[kernel]
        centre = cells.select("cell", *[F.col(a.name).alias(f"s_{a.name}") for a in used])
        far = {"h": lambda: haversine(F.col("s_latitude"), F.col("s_longitude"), F.col("latitude"), F.col("longitude")), "a": lambda: F.abs(F.col("altitude") - F.col("s_altitude")), "p": lambda: pressure_ratio(F.col("air_pressure"), F.col("s_air_pressure")), "t": lambda: F.abs(F.col("time") - F.col("s_time"))}[by]()
        order = F.struct(far, F.col(row_id) if row_id else F.lit(0))
        agg = binned.join(centre, "cell").groupBy("cell").agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in variables])
    else:
        agg = binned.groupBy("cell").agg(*kernels.data_only(kernel, variables, user_kernels))
    out = cells.join(agg, "cell", "left")
    if missing_grid is not None:
        outs = kernels.output_names(kernel, variables)
        out = out.join(missing_grid.select("cell", "missing"), "cell", "left").withColumns({o: F.when(~F.coalesce("missing", F.lit(False)), F.col(o)) for o in outs}).drop("missing")
    return out


def box_onto_grid(data: DataFrame, variables: list[str], axes: list[Axis], kernel: str = "moments", **separations) -> DataFrame:
    """The box kernel with a grid's cell centres as samples."""
    used = [a for a in axes if a.name in data.columns]
    cells = spine(data.sparkSession, used)
    return box(cells, data, variables, kernel, key="cell", **separations)


def within(sample: DataFrame, data: DataFrame, h_sep: float, key: str = "sample_id", row_id: str = "row_id") -> DataFrame:
    """key, row_id, distance (km) of the data within h_sep km of each sample: a sparse matrix of distances; count it for numbers of
    neighbours between two sets. With h_sep of half the circumference (20,038 km) or more it is the whole matrix."""
    near = tree.paired(sample.select(key, "latitude", "longitude"), data.select(row_id, "latitude", "longitude"), tree.Limits(h=h_sep))
    return near.select(F.col(f"s_{key}").alias(key), row_id, haversine(F.col("s_latitude"), F.col("s_longitude"), F.col("latitude"), F.col("longitude")).alias("distance"))


def nearest_k(sample: DataFrame, data: DataFrame, k: int, key: str = "sample_id", row_id: str = "row_id", h_sep: float | None = None) -> DataFrame:
    """key, rank (from 1), row_id, distance of each sample's k nearest data, fewer if there are fewer (within h_sep km, if given); ties to
    the smaller row_id, and data without one are left out. Leaves of data that k nearer ones shut out are never opened."""
    near, _ = tree.nearest_k(sample.where(F.col(key).isNotNull()), data, k, key, row_id, h_sep)
    order = Window.partitionBy(key).orderBy("distance", row_id)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", row_id, "distance")


def neighbour_pairs(points: DataFrame, h_sep: float, key: str) -> DataFrame:
    """Pairs a < b of points within h_sep km of each other, from a self-join on cells; count them for a number of neighbours."""
    p = points.select(key, "latitude", "longitude")
    q = pairs(p, p, h_sep=h_sep)
    return q.where(F.col(f"s_{key}") < F.col(key)).select(F.col(f"s_{key}").alias("a"), F.col(key).alias("b"))


def neighbour_counts(points: DataFrame, h_sep: float, key: str) -> DataFrame:
    """(a, n): of the points b > a within h_sep km of a point a, how many there are; as a count of neighbour_pairs(), with no pair made."""
    return tree.count_after(points, h_sep, key).groupBy(F.col(key).alias("a")).agg(F.sum("n").alias("n")).where("n > 0")
