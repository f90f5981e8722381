"""Queries over the test tables, one for each operator, with equivalent SQL.

The tables have no coordinates, so a view of `events` gives each row a place by integer arithmetic; it is whole: every event is a
point, and every event is a sample where points are collocated onto points. Grids to interpolate from are means of the events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, geo, units
from ..functions import time as tm
from ..operators import aggregate as ag
from ..operators import collocate as co
from ..operators import evaluate as ev
from ..operators import interpolate as ip
from ..operators import maths, plotdata, stats, tree
from ..operators.grid import Axis, spine
from ..operators.subset import subset
from ..sources import grids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

POLYGON = "POLYGON ((-55 0, 0 55, 55 0, 0 -55, -55 0))"
COORDS = ["latitude", "longitude", "altitude", "air_pressure", "time"]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    return e.select(
        k.cast("long").alias("event_id"), ((k * 7919) % 179999 / F.lit(1000.0) - 90).alias("latitude"), ((k * 104729) % 359987 / F.lit(1000.0) - 180).alias("longitude"), ((k % 101) * F.lit(100.0)).alias("altitude"), (F.lit(1000.0) - (k % 90) * 10).alias("air_pressure"),
        tm.std_time(F.col("ts")).alias("time"), F.col("value").alias("v"), F.col("user_id").cast("double").alias("w"), F.when(k % 7 != 0, F.col("value")).alias("v_m"),
        F.when((k % 97 == 0) & (((k * 7919) % 179999).between(90000, 120000)), F.lit(0.0)).otherwise(F.col("value")).alias("v_0"),
    )


POINTS = """points AS (SELECT event_id::BIGINT AS event_id, ((event_id * 7919) % 179999) / 1000.0::DOUBLE - 90 AS latitude, ((event_id * 104729) % 359987) / 1000.0::DOUBLE - 180 AS longitude,
 (event_id % 101) * 100.0::DOUBLE AS altitude, 1000.0::DOUBLE - (event_id % 90) * 10 AS air_pressure, (epoch_us(ts) - epoch_us(TIMESTAMP '1600-01-01')) / 86400e6::DOUBLE AS time,
 value AS v, user_id::DOUBLE AS w, CASE WHEN event_id % 7 <> 0 THEN value END AS v_m, CASE WHEN event_id % 97 = 0 AND (event_id * 7919) % 179999 BETWEEN 90000 AND 120000 THEN 0.0::DOUBLE ELSE value END AS v_0 FROM events)"""
HAVERSINE = "2 * 6378.0 * asin(sqrt(least(1.0, greatest(0.0, sin(radians(d.latitude - s.latitude) / 2) ** 2 + cos(radians(s.latitude)) * cos(radians(d.latitude)) * sin(radians(d.longitude - s.longitude) / 2) ** 2))))"


def digits(name: str) -> int:
    """A day's double has fewer digits after the point than a variable's."""
    return 6 if name.startswith("time") or name == "mid" else 8


def half_away(x: Column, n: int) -> Column:
    """x rounded to n digits as the SQL does it, which looks at the product x * 10^n; F.round looks at x's shortest decimal text, which is on the
    other side of a tie now and then."""
    y = F.abs(x) * F.lit(10.0**n)
    whole = F.floor(y).cast("double")
    near = F.when(y < 2.0**52, F.when(y - whole >= 0.5, whole + 1).otherwise(whole)).otherwise(y) / F.lit(10.0**n)
    near = F.when(y == float("inf"), F.abs(x)).otherwise(near)
    return F.when(x < 0, -near).otherwise(near)


def rounded(df: DataFrame) -> DataFrame:
    return df.select([half_away(F.col(c), digits(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    """Register a query under its function's name; sql follows the points view."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = f"WITH {POINTS}{', ' if sql.lstrip()[0] != 'S' else ' '}{sql}"
        return f

    return keep


def r(*names: str, table: str = "") -> str:
    return ", ".join(f"round({table}{n}, {digits(n)}) AS {n}" for n in names)


# scans and decoding


@query(f"SELECT event_id, {r(*COORDS, 'v', 'w', 'v_m', 'v_0')} FROM points")
def scan_points(spark, d):
    return decode.ingest(points(spark, d), COORDS, ["v", "w", "v_m", "v_0"])


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <> 13 AND l_quantity BETWEEN 2 AND 49 THEN l_quantity * 0.5 + 3 END, 8) AS cf, round(CASE WHEN l_quantity <> 13 THEN (l_quantity - 3) * 0.5 END, 8) AS modis, round(CASE WHEN l_quantity > 5 THEN (l_quantity - 3) / 4 END, 8) AS cloudsat, round(l_quantity / 4 + 3, 8) AS caliop FROM lineitem")
def decode_fill_range_scale(spark, d):
    x = F.col("l_quantity")
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", decode.scale_cf(decode.valid_range(decode.fill(x, 13.0), 2, 49), 0.5, 3).alias("cf"), decode.scale_modis(decode.fill(x, 13.0), 0.5, 3).alias("modis"), decode.scale_cloudsat(decode.missing_where(x, "<=", 5), 4, 3).alias("cloudsat"), decode.scale_caliop(x, 4, 3).alias("caliop"))


@query("SELECT event_id::BIGINT AS event_id, round(p.time, 6) AS time, abs(round(p.time * 86400e6::DOUBLE)::BIGINT - (epoch_us(e.ts) - epoch_us(TIMESTAMP '1600-01-01'))) <= 4 AS back, round(p.time + 0.25, 6) AS mid FROM points p JOIN events e USING (event_id)")
def std_time_roundtrip(spark, d):
    """To days and back: whether within four microseconds, which is what a day's double resolves."""
    e = spark.read.parquet(f"{d}/events.parquet")
    time = tm.std_time(F.col("ts"))
    back = F.abs(F.unix_micros(tm.to_timestamp(time)) - F.unix_micros(F.col("ts").cast("timestamp"))) <= 4
    return e.select(F.col("event_id").cast("long").alias("event_id"), time.alias("time"), back.alias("back"), tm.mid_time(time, time + 0.5).alias("mid"))


@query("""SELECT 'v' AS variable, count(*)::BIGINT AS total, count(v)::BIGINT AS present, round(min(v), 8) AS least, round(max(v), 8) AS greatest FROM points
 UNION ALL SELECT 'v_m', count(*)::BIGINT, count(v_m)::BIGINT, round(min(v_m), 8), round(max(v_m), 8) FROM points""")
def info_summary(spark, d):
    return stats.info(points(spark, d), ["v", "v_m"])


@query("SELECT event_id, k::INTEGER AS level, round(altitude + 500.0 * k, 8) AS altitude, round(v, 8) AS v FROM points, generate_series(0, 3) AS g(k)")
def broadcast_profile(spark, d):
    levels = spark.range(4).select(F.col("id").cast("int").alias("level"))
    return decode.broadcast_profile(points(spark, d), levels).select("event_id", "level", (F.col("altitude") + F.lit(500.0) * F.col("level")).alias("altitude"), "v")


@query("""t AS (SELECT user_id, event_id, value, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY event_id) - value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0.0) AS step FROM events)
 SELECT user_id, event_id, k::INTEGER AS sub, round(value + step * (k - 2.0) / 5, 8) AS value FROM t, generate_series(0, 4) AS g(k)""")
def densify_track(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value")
    return decode.densify_track(e, "event_id", ["value"], 5, ["user_id"]).select("user_id", "event_id", "sub", "value")


_side = "CASE WHEN {k} < 2 THEN {x} + ({x} - {p}) * (({k} - 2) / 5.0::DOUBLE) WHEN {k} = 2 THEN {x} ELSE {x} + ({n} - {x}) * (({k} - 2) / 5.0::DOUBLE) END"


@query(f"""s AS (SELECT event_id // 1000 AS g, event_id % 1000 // 10 AS r, event_id % 10 AS c, event_id, value FROM events),
 a AS (SELECT s.g, s.r, s.c, s.event_id, k AS sub_column, {_side.format(k='k', x='s.value', p='p.value', n='n.value')} AS x FROM s LEFT JOIN s p ON p.g = s.g AND p.r = s.r AND p.c = s.c - 1 LEFT JOIN s n ON n.g = s.g AND n.r = s.r AND n.c = s.c + 1, generate_series(0, 4) AS q(k))
 SELECT a.event_id, j::INTEGER AS sub_row, a.sub_column::INTEGER AS sub_column, round({_side.format(k='j', x='a.x', p='p.x', n='n.x')}, 8) AS value FROM a LEFT JOIN a p ON p.g = a.g AND p.r = a.r - 1 AND p.c = a.c AND p.sub_column = a.sub_column LEFT JOIN a n ON n.g = a.g AND n.r = a.r + 1 AND n.c = a.c AND n.sub_column = a.sub_column, generate_series(0, 4) AS q(j)""")
def densify_swath(spark, d):
    """Events as swaths of 100 lines with 10 points each, made five times as dense both ways."""
    k = F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value", F.floor(k / 1000).alias("swath"), F.floor(k % 1000 / 10).alias("line"), (k % 10).alias("pixel"))
    return decode.densify_swath(e, "line", "pixel", ["value"], 5, ["swath"]).select("event_id", "sub_row", "sub_column", "value")


@query("SELECT event_id, round(altitude / 1000, 8) AS km, round(air_pressure * 100, 8) AS pa, round(v - 273.15, 8) AS celsius FROM points")
def convert_units(spark, d):
    return points(spark, d).select("event_id", units.convert(F.col("altitude"), "m", "km").alias("km"), units.convert(F.col("air_pressure"), "hPa", "Pa").alias("pa"), units.convert(F.col("v"), "K", "degC").alias("celsius"))


# subsetting


@query(f"SELECT event_id, {r('latitude', 'longitude', 'v')} FROM points WHERE latitude BETWEEN -30 AND 30 AND longitude BETWEEN -60 AND 60")
def subset_range(spark, d):
    return subset(points(spark, d), y=(-30, 30), x=(-60, 60)).select("event_id", "latitude", "longitude", "v")


@query(f"SELECT event_id, {r('time', 'v')} FROM points WHERE time BETWEEN 154873.0 AND 154883.0 - 1.0/86400")
def subset_time_partial(spark, d):
    return subset(points(spark, d), t=("2024-01-11", "2024-01-20")).select("event_id", "time", "v")


@query("SELECT event_id, round(longitude - 360 * floor(longitude / 360), 8) AS longitude, round(v, 8) AS v FROM points WHERE longitude - 360 * floor(longitude / 360) BETWEEN 135 AND 270")
def subset_lon_wrap(spark, d):
    return subset(points(spark, d), x=(135, 270)).select("event_id", "longitude", "v")


@query(f"SELECT event_id, {r('latitude', 'longitude', 'v')} FROM points WHERE abs(latitude) + abs(longitude) < 55")
def subset_shape(spark, d):
    return subset(points(spark, d), shape=POLYGON).select("event_id", "latitude", "longitude", "v")


#: A coast of 2 x 2000 edges: two zigzag lines, joined at their ends.
COAST = [*((-120.0 + 240.0 * k / 2000, 40.0 + k * 7919 % 23) for k in range(2001)), *((-120.0 + 240.0 * k / 2000, -35.0 - k * 7907 % 19) for k in range(2000, -1, -1)), (-120.0, 40.0)]
COAST_SQL = """ring AS (SELECT k, -120.0::DOUBLE + 240.0::DOUBLE * k / 2000 AS x, 40.0::DOUBLE + k * 7919 % 23 AS y FROM generate_series(0, 2000) AS g(k)
 UNION ALL SELECT 4001 - k, -120.0::DOUBLE + 240.0::DOUBLE * k / 2000, -35.0::DOUBLE - k * 7907 % 19 FROM generate_series(0, 2000) AS g(k) UNION ALL SELECT 4002, -120.0::DOUBLE, 40.0::DOUBLE),
 edges AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ring a JOIN ring b ON b.k = a.k + 1),
 odd AS (SELECT event_id FROM points JOIN edges ON latitude >= least(y1, y2) AND latitude < greatest(y1, y2) AND longitude < x1 + (latitude - y1) * ((x2 - x1) / (y2 - y1)) GROUP BY event_id HAVING count(*) % 2 = 1),
 edge AS (SELECT DISTINCT event_id FROM points JOIN edges ON longitude BETWEEN least(x1, x2) AND greatest(x1, x2) AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2) AND (longitude - x1) * (y2 - y1) = (latitude - y1) * (x2 - x1))"""


@query(f"{COAST_SQL} SELECT event_id, {r('latitude', 'longitude', 'v')} FROM points WHERE event_id IN (FROM odd) AND event_id NOT IN (FROM edge)")
def subset_shape_coast(spark, d):
    wkt = "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in COAST) + "))"
    return subset(points(spark, d), shape=wkt).select("event_id", "latitude", "longitude", "v")


@query(f"SELECT event_id, {r('latitude', 'altitude', 'air_pressure', 'v')} FROM points WHERE abs(latitude) + abs(longitude) < 55 AND altitude BETWEEN 1000 AND 9000 AND air_pressure >= 200 AND v > 20")
def subset_multi(spark, d):
    return subset(points(spark, d), shape=POLYGON, z=(1000, 9000), p=(200, None), where=F.col("v") > 20).select("event_id", "latitude", "altitude", "air_pressure", "v")


@query("SELECT event_id, round(v, 8) AS v FROM points WHERE altitude BETWEEN 20000 AND 30000")
def subset_empty(spark, d):
    return subset(points(spark, d), z=(20000, 30000)).select("event_id", "v")


@query("SELECT event_id, round(CASE WHEN NOT v > 50 THEN v END, 8) AS masked FROM points")
def mask_where(spark, d):
    return ev.evaluate(points(spark, d), "numpy.ma.masked_where(v > 50, v)", "masked").select("event_id", "masked")


# aggregation

KERNEL_SQL = {"mean": "avg({v}) AS {v}", "moments": "avg({v}) AS {v}, stddev_samp({v}) AS {v}_std_dev, nullif(count({v}), 0) AS {v}_num_points", "stddev": "stddev_samp({v}) AS {v}", "min": "min({v}) AS {v}", "max": "max({v}) AS {v}", "sum": "sum({v}) AS {v}", "median": "median({v}) AS {v}", "gmean": "CASE WHEN min({v}) > 0 THEN exp(avg(CASE WHEN {v} > 0 THEN ln({v}) END)) WHEN min({v}) = 0 THEN 0.0 END AS {v}", "hmean": "CASE WHEN min({v}) > 0 THEN count({v}) / sum(CASE WHEN {v} <> 0 THEN 1.0 / {v} END) WHEN min({v}) = 0 THEN 0.0 END AS {v}", "RMS": "sqrt(avg({v} * {v})) AS {v}"}
LETTERS = {"y": ("latitude", -90.0, 90.0, 10.0), "x": ("longitude", -180.0, 180.0, 20.0), "z": ("altitude", 0.0, 10000.0, 2500.0), "t": ("time", 154863.0, 154893.0, 1.0), "p": ("air_pressure", 100.0, 1100.0, 250.0)}


def outs(how: str, variables: list[str]) -> list[str]:
    from ..operators.kernels import output_names

    return output_names(how, variables)


def agg_sql(how: str, axes: list[tuple], variables: list[str]) -> str:
    """Bins on a dense spine; edges are start + i * step."""
    import math

    names = [a[0] for a in axes]
    n = {a[0]: max(1, math.ceil((a[2] - a[1]) / a[3])) for a in axes}
    series = ", ".join(f"(SELECT unnest(generate_series(0, {n[c] - 1}))::INTEGER AS {c}_i)" for c in names)
    width = {a[0]: a[3] if n[a[0]] > 1 else a[2] - a[1] for a in axes}
    keys = ", ".join(f"floor(({c} - ({s})) / {width[c]})::INTEGER AS {c}_i" for c, s, _, _ in axes)
    test = " AND ".join(f"{c} >= {s} AND {c} < {s + n[c] * width[c]}" for c, s, _, _ in axes)
    cols = ", ".join(KERNEL_SQL[how].format(v=v) for v in variables)
    shown = ", ".join([f"{c}_i" for c in names] + [f"round({s}::DOUBLE + ({c}_i + 0.5::DOUBLE) * {w}, 8) AS {c}" for c, s, _, w in axes] + [f"round({o}, 8) AS {o}" if not o.endswith("num_points") else f"{o}::BIGINT AS {o}" for o in outs(how, variables)])
    return f"spine AS (SELECT * FROM {series}), b AS (SELECT {keys}, * FROM points WHERE {test}), g AS (SELECT {', '.join(f'{c}_i' for c in names)}, {cols} FROM b GROUP BY ALL) SELECT {shown} FROM spine LEFT JOIN g USING ({', '.join(f'{c}_i' for c in names)})"


def aggregation(name: str, how: str, letters: str, variables: list[str], axes: list[tuple] | None = None) -> None:
    axes = axes or [LETTERS[x] for x in letters]

    def run(spark, d):
        out = ag.aggregate(points(spark, d), variables, how, {c: (s, e, w) for c, s, e, w in axes})
        return out.select(*[f"{a[0]}_i" for a in axes], *[a[0] for a in axes], *outs(how, variables))

    run.__name__ = name
    query(agg_sql(how, axes, variables))(run)


for _name, _how, _letters, _vars in (
    ("agg_mean_xy", "mean", "yx", ["v"]), ("agg_moments_xy", "moments", "yx", ["v_m"]), ("agg_min_x", "min", "x", ["v"]), ("agg_max_y", "max", "y", ["v"]), ("agg_sum_t", "sum", "t", ["w"]), ("agg_stddev_xyz", "stddev", "yxz", ["v"]),
    ("agg_missing", "moments", "yxz", ["v_m"]), ("agg_multi_var", "moments", "yx", ["v", "w", "v_m"]), ("agg_time_p1d", "mean", "t", ["v"]), ("agg_median_p", "median", "p", ["v"]), ("agg_gmean_y", "gmean", "y", ["v_0"]), ("agg_hmean_y", "hmean", "y", ["v_0"]), ("agg_rms_z", "RMS", "z", ["v"]),
):
    aggregation(_name, _how, _letters, _vars)
aggregation("agg_overhang", "moments", "", ["v"], [("longitude", -125.0, 20.0, 40.0)])
aggregation("agg_one_cell", "mean", "", ["v"], [("latitude", -45.0, 45.0, 90.0)])


@query(f"SELECT {', '.join(f'round(min({c}), {digits(c)}) AS {c}_lo, round(max({c}), {digits(c)}) AS {c}_hi, round(min({c}) + (max({c}) - min({c})) / 2, {digits(c)}) AS {c}' for c in COORDS)}, round(avg(v), 8) AS v, round(stddev_samp(v), 8) AS v_std_dev, count(v)::BIGINT AS v_num_points FROM points")
def agg_collapse_all(spark, d):
    return ag.aggregate(points(spark, d), ["v"], "moments", {}, coords=COORDS).drop("cell")


# collapse of a grid of bin means

GRID = "g AS (SELECT floor((latitude + 90) / 10)::INTEGER AS y, floor((longitude + 180) / 20)::INTEGER AS x, avg(v_m) AS v FROM points GROUP BY ALL), grid AS (SELECT a.y, b.x, v FROM (SELECT unnest(generate_series(0, 17))::INTEGER AS y) a CROSS JOIN (SELECT unnest(generate_series(0, 17))::INTEGER AS x) b LEFT JOIN g ON g.y = a.y AND g.x = b.x)"
WEIGHT = "(6367470.0 ** 2 * radians(20.0) * (sin(radians(-80.0 + 10 * y)) - sin(radians(-90.0 + 10 * y))))"
GRID_AXES = [Axis.regular("latitude", -90, 90, 10), Axis.regular("longitude", -180, 180, 20)]


def grid(spark, d) -> DataFrame:
    return ag.aggregate(points(spark, d), ["v_m"], "mean", {"y": (-90, 90, 10), "x": (-180, 180, 20)}).withColumnRenamed("v_m", "v")


def collapse_query(name: str, how: str, collapsed: list[str], cols: str) -> None:
    keep = [c for c in ("latitude", "longitude") if c not in collapsed]
    key = {"latitude": "y", "longitude": "x"}

    def run(spark, d):
        dims = {"latitude": "latitude_i", "longitude": "longitude_i"}
        out = ag.collapse(grid(spark, d), ["v"], ["latitude_i", "longitude_i"], [dims[c] for c in collapsed], how, weight=ag.area_weight(F.col("latitude_lo"), F.col("latitude_hi"), F.col("longitude_lo"), F.col("longitude_hi")) if "latitude" in collapsed else None)
        return out

    run.__name__ = name
    query(f"{GRID} SELECT {''.join(f'{key[c]} AS {c}_i, ' for c in keep)}{cols} FROM grid{' GROUP BY ' + ', '.join(key[c] for c in keep) if keep else ''}")(run)


_mean = f"round(sum(CASE WHEN v IS NOT NULL THEN {WEIGHT} END * v) / sum(CASE WHEN v IS NOT NULL THEN {WEIGHT} END), 8) AS v"
collapse_query("col_mean_x", "mean", ["longitude"], "round(avg(v), 8) AS v")
collapse_query("col_mean_xy_weighted", "mean", ["latitude", "longitude"], _mean)
collapse_query("col_rms", "RMS", ["latitude"], f"round(sqrt(sum(CASE WHEN v IS NOT NULL THEN {WEIGHT} END * v * v) / sum(CASE WHEN v IS NOT NULL THEN {WEIGHT} END)), 8) AS v")
collapse_query("col_median", "median", ["longitude"], "round(median(v), 8) AS v")
collapse_query("col_gmean", "gmean", ["longitude"], "round(CASE WHEN min(v) > 0 THEN exp(avg(CASE WHEN v > 0 THEN ln(v) END)) WHEN min(v) = 0 THEN 0.0 END, 8) AS v")
collapse_query("col_hmean", "hmean", ["longitude"], "round(CASE WHEN min(v) > 0 THEN count(v) / sum(CASE WHEN v <> 0 THEN 1 / v END) WHEN min(v) = 0 THEN 0.0 END, 8) AS v")
collapse_query("col_min", "min", ["longitude"], "round(min(v), 8) AS v")
collapse_query("col_max", "max", ["latitude"], "round(max(v), 8) AS v")
collapse_query("col_stddev", "stddev", ["longitude"], "round(stddev_samp(v), 8) AS v")
collapse_query("col_moments", "moments", ["latitude"], f"{_mean}, round(stddev_samp(v), 8) AS v_std_dev, count(v)::BIGINT AS v_num_points")


@query(f"{GRID} SELECT x AS longitude_i, round(sum({WEIGHT} * v) / 1e12, 8) AS v FROM grid GROUP BY x")
def col_sum_y_weighted(spark, d):
    """The area integral, in millions of square kilometres times the variable."""
    out = ag.collapse(grid(spark, d), ["v"], ["latitude_i", "longitude_i"], ["latitude_i"], "sum", weight=ag.area_weight(F.col("latitude_lo"), F.col("latitude_hi"), F.col("longitude_lo"), F.col("longitude_hi")))
    return out.select("longitude_i", (F.col("v") / 1e12).alias("v"))


@query()
def col_peak(spark, d):
    return ag.collapse(grid(spark, d), ["v"], ["latitude_i", "longitude_i"], ["longitude_i"], "peak")


# collocation of points


def samples(p: DataFrame) -> DataFrame:
    return p.select(F.col("event_id").alias("sample_id"), *COORDS)


SAMPLES = "samples AS (SELECT event_id AS sample_id, latitude, longitude, altitude, air_pressure, time FROM points)"


def box_query(name: str, kernel: str, variable: str, test: str, **separations) -> None:
    names = outs(kernel, [variable])
    shown = ", ".join(f"round({o}, 8) AS {o}" if not o.endswith("num_points") else f"{o}::BIGINT AS {o}" for o in names)
    sep = {"h": HAVERSINE, "a": "abs(d.altitude - s.altitude)", "p": "greatest(d.air_pressure / s.air_pressure, s.air_pressure / d.air_pressure)", "t": "abs(d.time - s.time)"}
    test = test.format(**sep)
    if kernel.startswith("nn"):
        far = sep[kernel[3]]
        body = f"g AS (SELECT s.sample_id, arg_min(d.{variable}, ROW({far}, d.event_id)) AS {variable} FROM samples s JOIN points d ON d.{variable} IS NOT NULL AND {test} GROUP BY s.sample_id)"
    else:
        cols = KERNEL_SQL[kernel].format(v=variable)
        body = f"m AS (SELECT s.sample_id, d.{variable} FROM samples s JOIN points d ON d.{variable} IS NOT NULL AND {test}), g AS (SELECT sample_id, {cols} FROM m GROUP BY sample_id)"

    def run(spark, d):
        p = points(spark, d)
        return co.box(samples(p), p.select("event_id", *COORDS, variable), [variable], kernel, row_id="event_id", **separations).select("sample_id", *names)

    run.__name__ = name
    query(f"{SAMPLES}, {body} SELECT sample_id, {shown} FROM samples LEFT JOIN g USING (sample_id)")(run)


box_query("box_h_mean", "mean", "v_m", "{h} <= 777.7", h_sep=777.7)
box_query("box_h_moments", "moments", "v_m", "{h} <= 503.3", h_sep=503.3)
box_query("box_hat_mean", "mean", "v", "{h} <= 2003.3 AND {a} < 1550 AND {t} < 9.5", h_sep=2003.3, a_sep=1550, t_sep=9.5)
box_query("box_p_mean", "mean", "v", "{p} < 1.013", p_sep=1.013)
box_query("box_t_sum", "sum", "w", "{t} < 0.253", t_sep=0.253)
box_query("box_none", "moments", "v", "true")
box_query("nn_h", "nn_h", "v", "{h} <= 903.3", h_sep=903.3)
box_query("nn_a", "nn_a", "v", "{h} <= 1003.3", h_sep=1003.3)
box_query("nn_p", "nn_p", "v", "{h} <= 1003.3", h_sep=1003.3)
box_query("nn_t", "nn_t", "v_m", "{h} <= 1003.3", h_sep=1003.3)


@query(f"{SAMPLES} SELECT sample_id, round(arg_min(d.v_m, ROW({HAVERSINE}, d.event_id)), 8) AS v FROM samples s CROSS JOIN points d WHERE d.v_m IS NOT NULL GROUP BY sample_id")
def nn_horizontal_only(spark, d):
    p = points(spark, d)
    return co.nearest(samples(p), p.select("event_id", *COORDS, F.col("v_m").alias("v")), ["v"], row_id="event_id").select("sample_id", "v")


@query(f"{SAMPLES}, c AS (SELECT unnest(generate_series(0, 17))::INTEGER AS latitude_i), x AS (SELECT unnest(generate_series(0, 8))::INTEGER AS longitude_i), cells AS (SELECT latitude_i, longitude_i, -85.0 + 10 * latitude_i AS latitude, -160.0 + 40 * longitude_i AS longitude FROM c CROSS JOIN x), g AS (SELECT latitude_i, longitude_i, avg(d.v) AS v FROM cells s JOIN points d ON {HAVERSINE} <= 503.3 GROUP BY ALL) SELECT latitude_i, longitude_i, round(v, 8) AS v FROM cells LEFT JOIN g USING (latitude_i, longitude_i)")
def box_onto_grid(spark, d):
    axes = [Axis.regular("latitude", -90, 90, 10), Axis.regular("longitude", -180, 180, 40)]
    return co.box_onto_grid(points(spark, d), ["v"], axes, "mean", h_sep=503.3).select("latitude_i", "longitude_i", "v")


@query(f"SELECT s.event_id AS a, count(*)::BIGINT AS n FROM points s JOIN points d ON s.event_id < d.event_id AND {HAVERSINE} <= 403.3 GROUP BY s.event_id")
def neighbour_counts(spark, d):
    """Neighbours within a distance, of every event."""
    return co.neighbour_counts(points(spark, d), 403.3, "event_id")


RADII = [150.0, 403.3, 1503.3, 6003.3, 12003.3]


@query(f"{SAMPLES}, m AS (SELECT {HAVERSINE} AS far FROM samples s CROSS JOIN points d) SELECT r.radius, count(*)::BIGINT AS n FROM m JOIN (VALUES {', '.join(f'({x}::DOUBLE)' for x in RADII)}) AS r(radius) ON m.far <= r.radius GROUP BY r.radius")
def neighbour_counts_radii(spark, d):
    """Pairs of events within each of five distances, each event with itself too."""
    p = points(spark, d)
    return tree.count_within(p, p, RADII)[0]


def along_query(name: str, kernel: str, column: str, far: str) -> None:
    """The nearest in one coordinate, without a separation; SQL looks at one row for each of the data's values."""

    def run(spark, d):
        p = points(spark, d)
        return co.box(samples(p), p.select("event_id", *COORDS, "v_m"), ["v_m"], kernel, row_id="event_id").select("sample_id", "v_m")

    run.__name__ = name
    query(f"{SAMPLES}, d AS (SELECT {column}, min(event_id) AS e, arg_min(v_m, event_id) AS v FROM points WHERE v_m IS NOT NULL GROUP BY {column}), q AS (SELECT s.{column} AS x, arg_min(d.v, ROW({far}, d.e)) AS v FROM (SELECT DISTINCT {column} FROM samples) s CROSS JOIN d GROUP BY s.{column}) SELECT sample_id, round(v, 8) AS v_m FROM samples JOIN q ON q.x = samples.{column}")(run)


along_query("nn_a_any", "nn_a", "altitude", "abs(d.altitude - s.altitude)")
along_query("nn_p_any", "nn_p", "air_pressure", "greatest(d.air_pressure / s.air_pressure, s.air_pressure / d.air_pressure)")
along_query("nn_t_any", "nn_t", "time", "abs(d.time - s.time)")


@query(f"{SAMPLES}, m AS (SELECT s.sample_id, d.event_id AS row_id, {HAVERSINE} AS distance FROM samples s JOIN points d ON {HAVERSINE} <= 403.3) SELECT sample_id, row_id, round(distance, 8) AS distance FROM m")
def distance_matrix(spark, d):
    p = points(spark, d)
    return co.within(samples(p), p.withColumnRenamed("event_id", "row_id"), 403.3)


@query(f"{SAMPLES}, m AS (SELECT s.sample_id, d.event_id AS row_id, {HAVERSINE} AS distance FROM samples s JOIN points d ON {HAVERSINE} <= 703.3), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, row_id)::INTEGER AS rank FROM m) SELECT sample_id, rank, row_id, round(distance, 8) AS distance FROM k WHERE rank <= 3")
def nearest_three(spark, d):
    p = points(spark, d)
    return co.nearest_k(samples(p), p.withColumnRenamed("event_id", "row_id"), 3, h_sep=703.3)


UNEVEN = [(-80.0, -35.0), (-35.0, -5.0), (-5.0, 10.0), (20.0, 65.0)]


@query("cells AS (SELECT * FROM (VALUES (0, -80.0, -35.0), (1, -35.0, -5.0), (2, -5.0, 10.0), (3, 20.0, 65.0)) AS t(latitude_i, lo, hi)), g AS (SELECT latitude_i, avg(v_m) AS v_m, stddev_samp(v_m) AS v_m_std_dev, nullif(count(v_m), 0) AS v_m_num_points FROM cells JOIN points ON latitude >= lo AND latitude < hi GROUP BY latitude_i) SELECT latitude_i::INTEGER AS latitude_i, round(v_m, 8) AS v_m, round(v_m_std_dev, 8) AS v_m_std_dev, v_m_num_points::BIGINT AS v_m_num_points FROM cells LEFT JOIN g USING (latitude_i)")
def bin_onto_grid(spark, d):
    return co.bin_onto(points(spark, d), ["v_m"], [Axis.bounded("latitude", UNEVEN)]).select("latitude_i", "v_m", "v_m_std_dev", "v_m_num_points")


#: 200,000 cells whose steps grow with their number, a part of each step in none.
LONG_AXIS = 200_000


@query(f"""cells AS (SELECT (k - 1)::INTEGER AS latitude_i, (k * k) / 268435456.0::DOUBLE - 90 AS lo, (k * k + k) / 268435456.0::DOUBLE - 90 AS hi FROM generate_series(1, {LONG_AXIS}) AS g(k)),
 held AS (SELECT c.latitude_i, p.v, p.latitude < c.hi AS inside FROM points p ASOF JOIN cells c ON p.latitude >= c.lo), g AS (SELECT latitude_i, sum(v) AS v FROM held WHERE inside GROUP BY latitude_i)
 SELECT latitude_i, round(lo, 8) AS latitude_lo, round(v, 8) AS v FROM cells LEFT JOIN g USING (latitude_i)""")
def bin_long_axis(spark, d):
    """Bins of a long axis of uneven cells with gaps."""
    cells = [(k * k / 2.0**28 - 90, (k * k + k) / 2.0**28 - 90) for k in range(1, LONG_AXIS + 1)]
    return co.bin_onto(points(spark, d), ["v"], [Axis.bounded("latitude", cells)], "sum").select("latitude_i", "latitude_lo", "v")


@query(f"{GRID}, b AS (SELECT floor((latitude + 90) / 10)::INTEGER AS y, floor((longitude + 180) / 20)::INTEGER AS x, max(w) AS w FROM points GROUP BY ALL) SELECT grid.y AS latitude_i, grid.x AS longitude_i, round(CASE WHEN (grid.y + grid.x) % 3 <> 0 THEN w END, 8) AS w FROM grid LEFT JOIN b ON b.y = grid.y AND b.x = grid.x")
def bin_missing_sample(spark, d):
    mask = spine(spark, GRID_AXES).select("cell", ((F.col("latitude_i") + F.col("longitude_i")) % 3 == 0).alias("missing"))
    return co.bin_onto(points(spark, d), ["w"], GRID_AXES, "max", missing_grid=mask).select("latitude_i", "longitude_i", "w")


# grids from cells

DEGREES = "cells AS (SELECT -82.5::DOUBLE + 15 * floor((latitude + 90) / 15) AS latitude, -170.0::DOUBLE + 20 * floor((longitude + 180) / 20) AS longitude{more}, avg(v_m) AS v FROM points GROUP BY ALL)"
NUMBERED = "n AS (SELECT *, (dense_rank() OVER (ORDER BY latitude) - 1)::INTEGER AS latitude_i, (dense_rank() OVER (ORDER BY longitude) - 1)::INTEGER AS longitude_i{more} FROM cells)"


def degrees(p: DataFrame, *more) -> DataFrame:
    """Means of the events by 15 x 20 degrees, as a file of cells holds them: with the values of their coordinates."""
    lat, lon = F.lit(-82.5) + 15 * F.floor((F.col("latitude") + 90) / 15), F.lit(-170.0) + 20 * F.floor((F.col("longitude") + 180) / 20)
    return p.groupBy(lat.alias("latitude"), lon.alias("longitude"), *more).agg(F.avg("v_m").alias("v"))


@query(f"{DEGREES.format(more='')}, {NUMBERED.format(more='')} SELECT (latitude_i * (SELECT count(DISTINCT longitude) FROM cells) + longitude_i)::BIGINT AS cell, latitude_i, round(latitude - 7.5, 8) AS latitude_lo, longitude_i, round(longitude + 10, 8) AS longitude_hi, round(v, 8) AS v FROM n")
def grid_from_points(spark, d):
    """A grid whose axes are found from its cells."""
    out, _ = grids.grid_of(degrees(points(spark, d)), ["v"])
    return out.select("cell", "latitude_i", "latitude_lo", "longitude_i", "longitude_hi", "v")


@query(f"{DEGREES.format(more=', 154863.5::DOUBLE + 7.5 * least(greatest(floor((time - 154863) / 7.5), 0), 3) AS time')}, {NUMBERED.format(more=', (dense_rank() OVER (ORDER BY time) - 1)::INTEGER AS time_i')}, m AS (SELECT time_i, longitude_i, avg(v) AS v FROM n GROUP BY ALL) SELECT time_i, longitude_i, round(v, 8) AS v FROM m")
def grid_merge_files(spark, d):
    """Four files, each with one time of its own, as one grid with an axis of times; then its mean over latitudes."""
    p, k = points(spark, d), F.least(F.greatest(F.floor((F.col("time") - 154863) / 7.5), F.lit(0)), F.lit(3))
    files = [degrees(p.where(k == i)).withColumn("time", F.lit(154863.5 + 7.5 * i)) for i in range(4)]
    out, _ = grids.merge(files, ["v"])
    return ag.collapse(out, ["v"], ["latitude_i", "longitude_i", "time_i"], ["latitude_i"], "mean").select("time_i", "longitude_i", "v")


# interpolation from a grid of means of the events, with some cells missing

IP_AXES = [Axis.of_points("latitude", [-90.0 + 15 * i for i in range(13)]), Axis.of_points("longitude", [-180.0 + 30 * i for i in range(12)], cyclic=True)]
NEAR_Y, NEAR_X = "floor((latitude + 97.5) / 15)::INTEGER", "(floor((longitude + 195) / 30)::INTEGER % 12)"
IP_GRID = f"grid AS (SELECT y, x, CASE WHEN (y * 12 + x) % 37 <> 5 THEN v END AS v FROM (SELECT {NEAR_Y} AS y, {NEAR_X} AS x, avg(v) AS v FROM points GROUP BY ALL))"
INNER_GRID = f"line AS (SELECT {NEAR_Y} - 3 AS y, avg(v) AS v FROM points WHERE {NEAR_Y} BETWEEN 3 AND 9 GROUP BY ALL)"


def near(name: str, start: float, step: float):
    """The number of the axis point nearest to each event."""
    return F.floor((F.col(name) - start + step / 2) / step).cast("int")


def ip_grid(spark, d) -> DataFrame:
    y, x = F.col("latitude_i"), F.col("longitude_i")
    cells = points(spark, d).groupBy(near("latitude", -90.0, 15.0).alias("latitude_i"), (near("longitude", -180.0, 30.0) % 12).alias("longitude_i")).agg(F.avg("v").alias("v"))
    return cells.select("latitude_i", "longitude_i", F.when((y * 12 + x) % 37 != 5, F.col("v")).alias("v"))


def inner_line(spark, d) -> DataFrame:
    cells = points(spark, d).groupBy((near("latitude", -90.0, 15.0) - 3).alias("latitude_i")).agg(F.avg("v").alias("v"))
    return cells.where("latitude_i BETWEEN 0 AND 6")


PLACE = "i AS (SELECT sample_id, latitude, longitude, least(greatest(ceil((latitude + 90) / 15) - 1, 0), 11)::INTEGER AS y, least(greatest(ceil((longitude + 180) / 30) - 1, 0), 11)::INTEGER AS x FROM samples), u AS (SELECT *, (latitude + 90) / 15 - y AS p, (longitude + 180) / 30 - x AS q FROM i)"
CORNERS = "c AS (SELECT sample_id, y + a AS y, (x + b) % 12 AS x, (CASE WHEN a = 1 THEN p ELSE 1 - p END) * (CASE WHEN b = 1 THEN q ELSE 1 - q END) AS k FROM u, (VALUES (0), (1)) AS s(a), (VALUES (0), (1)) AS t(b))"
LINEAR = f"{SAMPLES}, {IP_GRID}, {PLACE}, {CORNERS} SELECT sample_id, round(CASE WHEN count(v) = 4 THEN sum(k * v) END, 8) AS v FROM c JOIN grid USING (y, x) GROUP BY sample_id"


@query(LINEAR)
def lin_grid_to_points(spark, d):
    return ip.onto_points(samples(points(spark, d)), ip_grid(spark, d), ["v"], IP_AXES).select("sample_id", "v")


@query(f"{SAMPLES}, {IP_GRID}, {PLACE} SELECT sample_id, round(v, 8) AS v FROM u JOIN grid ON grid.y = u.y + (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AND grid.x = (u.x + (CASE WHEN q > 0.5 THEN 1 ELSE 0 END)) % 12")
def nn_grid_to_points(spark, d):
    return ip.onto_points(samples(points(spark, d)), ip_grid(spark, d), ["v"], IP_AXES, "nn").select("sample_id", "v")


INNER = [Axis.of_points("latitude", [-45.0 + 15 * i for i in range(7)])]
BETWEEN = f"{SAMPLES}, {INNER_GRID}, i AS (SELECT sample_id, latitude, least(greatest(ceil((latitude + 45) / 15) - 1, 0), 5)::INTEGER AS y FROM samples), e AS (SELECT sample_id, latitude, i.y, (latitude + 45) / 15 - i.y AS u, a.v AS lo, b.v AS hi FROM i JOIN line a ON a.y = i.y JOIN line b ON b.y = i.y + 1)"


@query(f"{BETWEEN} SELECT sample_id, round((1 - u) * lo + u * hi, 8) AS v FROM e")
def lin_extrapolate(spark, d):
    return ip.onto_points(samples(points(spark, d)), inner_line(spark, d), ["v"], INNER, extrapolate=True).select("sample_id", "v")


@query(f"{BETWEEN} SELECT sample_id, round(CASE WHEN latitude BETWEEN -45 AND 45 AND y <> 2 AND y + 1 <> 2 THEN (1 - u) * lo + u * hi END, 8) AS v FROM e")
def lin_null_corner(spark, d):
    g = inner_line(spark, d).withColumn("v", F.when(F.col("latitude_i") != 2, F.col("v")))
    return ip.onto_points(samples(points(spark, d)), g, ["v"], INNER).select("sample_id", "v")


TARGET = [Axis.of_points("latitude", [-80.0 + 20 * i for i in range(9)]), Axis.of_points("longitude", [-170.0 + 20 * i for i in range(18)])]
TARGET_SQL = "samples AS (SELECT (y * 18 + x)::BIGINT AS sample_id, -80.0::DOUBLE + 20 * y AS latitude, -170.0::DOUBLE + 20 * x AS longitude FROM generate_series(0, 8) AS a(y), generate_series(0, 17) AS b(x))"


@query(f"{TARGET_SQL}, {IP_GRID}, {PLACE}, {CORNERS} SELECT sample_id AS cell, round(CASE WHEN count(v) = 4 THEN sum(k * v) END, 8) AS v FROM c JOIN grid USING (y, x) GROUP BY sample_id")
def lin_grid_to_grid(spark, d):
    return ip.onto_grid(ip_grid(spark, d), ["v"], IP_AXES, TARGET).select("cell", "v")


@query(f"{TARGET_SQL}, {IP_GRID}, {PLACE} SELECT sample_id AS cell, round(v, 8) AS v FROM u JOIN grid ON grid.y = u.y + (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AND grid.x = (u.x + (CASE WHEN q > 0.5 THEN 1 ELSE 0 END)) % 12")
def nn_grid_to_grid(spark, d):
    return ip.onto_grid(ip_grid(spark, d), ["v"], IP_AXES, TARGET, "nn").select("cell", "v")


@query(f"{SAMPLES}, line AS (SELECT {NEAR_Y} AS y, avg(v) AS v FROM points GROUP BY ALL), i AS (SELECT *, least(greatest(ceil((latitude + 90) / 15) - 1, 0), 11)::INTEGER AS y FROM samples), e AS (SELECT sample_id, altitude, latitude, (1 - ((latitude + 90) / 15 - i.y)) * a.v + ((latitude + 90) / 15 - i.y) * b.v AS base FROM i JOIN line a ON a.y = i.y JOIN line b ON b.y = i.y + 1) SELECT sample_id, round(CASE WHEN altitude BETWEEN 200 + 10 * (latitude + 90) / 15 AND 9800 + 10 * (latitude + 90) / 15 THEN (altitude - 200 - 10 * (latitude + 90) / 15) / 1200 * 3 + base END, 8) AS v FROM e")
def lin_hybrid_height(spark, d):
    """Heights of levels vary with latitude; the variable is a mean of the events at each latitude, and rises by 3 a level."""
    lat = IP_AXES[:1]
    k, z = F.col("latitude_i"), F.col("level")
    line = points(spark, d).groupBy(near("latitude", -90.0, 15.0).alias("latitude_i")).agg(F.avg("v").alias("base"))
    levels = line.crossJoin(F.broadcast(spark.range(9).select(F.col("id").cast("int").alias("level")))).select("latitude_i", "level", (F.lit(200.0) + 1200 * z + 10 * k).alias("height"), (F.lit(3.0) * z + F.col("base")).alias("v"))
    return ip.onto_points_hybrid(samples(points(spark, d)), levels, ["v"], lat, level="level", vertical="height", at="altitude").select("sample_id", "v")


# expressions


@query("SELECT event_id, round(v * 2 + w / 3 - altitude ** 0.5, 8) AS out FROM points")
def eval_arith(spark, d):
    return ev.evaluate(points(spark, d), "v * 2 + w / 3 - altitude ** 0.5", "out").select("event_id", "out")


@query("SELECT event_id, round(CASE WHEN w > 0 THEN ln(v / w) END, 8) AS out FROM points")
def eval_log_ratio(spark, d):
    return ev.evaluate(points(spark, d), "numpy.log(v / w)", "out").select("event_id", "out")


@query("SELECT event_id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 8) AS out FROM points")
def eval_global_mean(spark, d):
    return ev.evaluate(points(spark, d), "(v - numpy.mean(v)) / numpy.std(v)", "out").select("event_id", "out")


@query("SELECT event_id, round(CASE WHEN v > w THEN v ELSE -w END, 8) AS out, round(CASE WHEN v_m IS NOT NULL THEN greatest(v_m, w) END, 8) AS top FROM points")
def eval_where(spark, d):
    out = ev.evaluate(points(spark, d), "numpy.where(v > w, v, -w)", "out")
    return ev.evaluate(out, "numpy.maximum(v_m, w)", "top").select("event_id", "out", "top")


@query("SELECT event_id, round(CASE WHEN event_id % 5 <> 0 THEN v / (event_id % 5) END, 8) AS ratio, round(v + w, 8) AS total, round(v * v, 8) AS square FROM points")
def maths_divide_zero(spark, d):
    p = points(spark, d).withColumn("k", (F.col("event_id") % 5).cast("double"))
    return maths.exponentiate(maths.add(maths.divide(p, "v", "k", "ratio"), "v", "w", "total"), "v", 2, "square").select("event_id", "ratio", "total", "square")


# statistics and plot data

PAIRS = "p AS (SELECT {x} AS x, {y} AS y FROM points WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
STATS = """SELECT count(*)::BIGINT AS num_points, round(avg(x), 8) AS dataset_mean_1, round(avg(y), 8) AS dataset_mean_2, round(stddev_samp(x), 8) AS dataset_stddev_1, round(stddev_samp(y), 8) AS dataset_stddev_2, round(avg(y - x), 8) AS abs_mean, round(stddev_samp(y - x), 8) AS abs_stddev,
 round(avg(CASE WHEN x <> 0 THEN (y - x) / x END), 8) AS rel_mean, round(stddev_samp(CASE WHEN x <> 0 THEN (y - x) / x END), 8) AS rel_stddev, round(regr_slope(y, x), 8) AS regression_gradient, round(regr_intercept(y, x), 8) AS regression_intercept, round(corr(x, y), 8) AS regression_r, round(sqrt((1 - corr(x, y) ** 2) * var_samp(y) / (var_samp(x) * (count(*) - 2))), 8) AS regression_stderr"""
RANKS = "q AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM p)"


@query(f"{PAIRS.format(x='w', y='v')}, {RANKS} {STATS}, (SELECT round(corr(a, b), 8) FROM q) AS spearman FROM p")
def stats_full(spark, d):
    return stats.stats(points(spark, d), "w", "v")


@query(f"{PAIRS.format(x='altitude', y='v')}, {RANKS} SELECT round(corr(a, b), 8) AS spearman FROM q")
def stats_spearman(spark, d):
    return stats.spearman(points(spark, d), "altitude", "v")


@query(f"{PAIRS.format(x='v_m', y='w')} {STATS} FROM p")
def stats_missing(spark, d):
    return stats.stats(points(spark, d), "v_m", "w", with_spearman=False)


@query("e AS (SELECT min(w) AS a, max(w) AS b FROM points) SELECT least(floor((w - a) / ((b - a) / 10)), 9)::INTEGER AS bin, count(*)::BIGINT AS n FROM points, e GROUP BY 1")
def hist_10(spark, d):
    return stats.histogram(points(spark, d), "w").select("bin", "n")


@query("p AS (SELECT w, altitude AS y FROM points), e AS (SELECT min(w) AS a, max(w) AS b, min(y) AS c, max(y) AS d FROM p) SELECT least(floor((w - a) / ((b - a) / 10)), 9)::INTEGER AS x_bin, least(floor((y - c) / ((d - c) / 10)), 9)::INTEGER AS y_bin, count(*)::BIGINT AS n FROM p, e GROUP BY 1, 2")
def hist2d(spark, d):
    return stats.histogram2d(points(spark, d), "w", "altitude")


@query("""SELECT 'v' AS variable, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS stddev, 1.0::DOUBLE AS gamma, 0.0::DOUBLE AS bias, 1.0::DOUBLE AS corr FROM points
 UNION ALL SELECT 'w', round(avg(w), 8), round(stddev_samp(w), 8), round(stddev_samp(w) / stddev_samp(v), 8), round((avg(w) - avg(v)) / stddev_samp(v), 8), round(corr(v, w), 8) FROM points
 UNION ALL SELECT 'v_m', round(avg(v_m), 8), round(stddev_samp(v_m), 8), round(stddev_samp(v_m) / stddev_samp(v) FILTER (WHERE v_m IS NOT NULL), 8), round((avg(v_m) - avg(v) FILTER (WHERE v_m IS NOT NULL)) / stddev_samp(v) FILTER (WHERE v_m IS NOT NULL), 8), 1.0 FROM points""")
def taylor(spark, d):
    return stats.taylor(points(spark, d), ["v", "w", "v_m"])


@query(f"{GRID} SELECT x AS x_i, y AS y_i, round(-170.0::DOUBLE + 20 * x, 8) AS x, round(-85.0::DOUBLE + 10 * y, 8) AS y, round(v, 8) AS v FROM (SELECT y, x, v FROM grid UNION ALL SELECT y, 18 AS x, v FROM grid WHERE x = 0)")
def plot_mesh(spark, d):
    return plotdata.mesh(grid(spark, d), "v", [GRID_AXES[1], GRID_AXES[0]]).select("x_i", "y_i", "x", "y", "v")


@query("SELECT k::INTEGER AS level, round(a + (b - a) * k / 6, 8) AS v FROM (SELECT min(v) AS a, max(v) AS b FROM points), generate_series(0, 6) AS g(k)")
def plot_levels(spark, d):
    return plotdata.contour_levels(points(spark, d), "v")


@query("SELECT round(time - 135140, 6) AS time_1970, round(v_m, 8) AS v FROM points WHERE v_m IS NOT NULL")
def plot_scatter(spark, d):
    return plotdata.points(points(spark, d), "v_m").select(F.col("x").alias("time_1970"), "v")


@query("p AS (SELECT altitude AS x, v_m AS y FROM points WHERE v_m IS NOT NULL) SELECT round(least(min(x), min(y)), 8) AS x, round(least(min(x), min(y)), 8) AS y FROM p UNION ALL SELECT round(greatest(max(x), max(y)), 8), round(greatest(max(x), max(y)), 8) FROM p")
def plot_diagonal(spark, d):
    return plotdata.comparative_scatter(points(spark, d), "altitude", "v_m")[1]


@query("SELECT event_id, v_m IS NOT DISTINCT FROM (CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN v END) AS same FROM points")
def equal_missing(spark, d):
    other = F.when((F.col("event_id") % 7 != 0) & (F.col("event_id") % 11 != 0), F.col("v"))
    return points(spark, d).select("event_id", decode.equal_including_missing(F.col("v_m"), other).alias("same"))


@query("SELECT event_id, round(greatest(500 / air_pressure, air_pressure / 500), 8) AS ratio, round(-latitude, 8) AS lat, round((longitude + 180) + 180 - 360 * floor(((longitude + 180) + 180) / 360) - 180, 8) AS lon FROM points")
def point_separations(spark, d):
    lat, lon = geo.antipode(F.col("latitude"), F.col("longitude"))
    return points(spark, d).select("event_id", geo.pressure_ratio(F.lit(500.0), F.col("air_pressure")).alias("ratio"), lat.alias("lat"), lon.alias("lon"))


@query("SELECT (floor((latitude + 90) / 10) * 18 + floor((longitude + 180) / 20))::BIGINT AS cell, floor((latitude + 90) / 10)::INTEGER AS latitude_i, round(-170.0::DOUBLE + 20 * floor((longitude + 180) / 20), 8) AS longitude, nullif(count(v_m), 0)::BIGINT AS n FROM points GROUP BY ALL")
def sparse_cells(spark, d):
    out = ag.aggregate(points(spark, d), ["v_m"], "moments", {"y": (-90, 90, 10), "x": (-180, 180, 20)}, dense=False)
    return out.select("cell", "latitude_i", "longitude", F.col("v_m_num_points").alias("n"))
