"""Hand-computed results on small inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from fixtures import DAY, LAT, LON, grid_5x3, lidar, pts, pts_5x3, samples, values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyweave.errors import CoordinateNotFoundError, EvaluationError, NoDataInSubsetError
from skyweave.functions import decode, geo, names, units
from skyweave.functions import time as tm
from skyweave.operators import aggregate as ag
from skyweave.operators import collocate as co
from skyweave.operators import evaluate as ev
from skyweave.operators import interpolate as ip
from skyweave.operators import kernels, maths, stats
from skyweave.operators.grid import Axis, spine
from skyweave.operators.subset import require_rows, subset, subset_grid

N = None


def agg(df, how, grid, column="v"):
    return values(ag.aggregate(df, ["v"], how, grid).withColumnRenamed(column, "out"), "cell", "out")


# aggregation


def test_aggregate_single_points(spark):
    y = {"y": (-12.5, 12.5, 5)}
    for lat, cell in ((0, 2), (-2.5, 2), (2.5, 3), (-12.5, 0)):
        assert agg(samples(spark, [(lat, 0, 1)], ("latitude", "longitude", "v")), "mean", y) == [1.0 if i == cell else N for i in range(5)]
    assert agg(samples(spark, [(12.5, 0, 1)], ("latitude", "longitude", "v")), "mean", y) == [N] * 5


def test_aggregate_goldens(spark):
    p, m = pts_5x3(spark), pts_5x3(spark, missing=(5, 9, 13))
    assert agg(p, "mean", {"y": (-10, 10, 5), "x": (-5, 5, 5)}) == [1, 2, 4, 5, 7, 8, 10, 11]
    g = {"y": (-12.5, 12.5, 12.5), "x": (-7.5, 7.5, 5)}
    assert agg(m, "mean", g) == [2.5, 2, 4.5, 8.5, 11, 13.5]
    assert agg(m, "max", g) == [4, 2, 6, 10, 14, 15]
    assert agg(m, "min", g) == [1, 2, 3, 7, 8, 12]
    s = round(math.sqrt(4.5), 6)
    assert agg(m, "stddev", g) == [s, N, s, s, 3, s]
    out = ag.aggregate(p, ["v"], "moments", {"y": (-12.5, 12.5, 12.5)}).orderBy("cell").collect()
    assert [(r.v, round(r.v_std_dev, 6), r.v_num_points) for r in out] == [(3.5, round(math.sqrt(3.5), 6), 6), (11, round(math.sqrt(7.5), 6), 9)]


def test_aggregate_wraps_and_overhangs(spark):
    wide = pts(spark, (-5, 5), range(-175, 146, 40))
    assert agg(wide, "mean", {"x": (125, 270, 40)}) == [13.5, 5.5, 6.5, 7.5]
    east = pts(spark, (-5, 5), range(5, 326, 40))
    assert agg(east, "mean", {"x": (-75, 125, 40)}) == [12.5, 13.5, 5.5, 6.5, 7.5]


def test_aggregate_collapses_the_rest_and_checks_keys(spark):
    out = ag.aggregate(pts_5x3(spark), ["v"], "moments", {"y": (-12.5, 12.5, 12.5)}, coords=["latitude", "longitude"]).first()
    assert (out.longitude_lo, out.longitude, out.longitude_hi) == (-5, 0, 5)
    with pytest.raises(CoordinateNotFoundError):
        ag.aggregate(pts_5x3(spark), ["v"], "mean", {"z": (0, 1, 1)})
    with pytest.raises(ValueError):
        ag.aggregate(pts_5x3(spark), ["v"], "mean", {"y": (0, 1, None)})
    assert agg(pts_5x3(spark), "mean", {"y": (None, None, 10)}) == [3.5, 9.5]
    assert ag.aggregate(pts_5x3(spark), ["v"], "mean", {"y": (-90, 90, 1)}, dense=False).count() == 5


@settings(max_examples=25, deadline=None)
@given(st.floats(-50, 50), st.floats(0.01, 7), st.integers(1, 40))
def test_axis_cells_cover_once(start, step, n):
    a = Axis.regular("x", start, start + step * n, step)
    assert len(a) in (n, n + 1) and list(a.lo[1:]) == list(a.hi[:-1])


def test_index_agrees_with_edges(spark):
    a = Axis.regular("x", -0.3, 1.2, 0.1)
    xs = sorted({*a.lo, *a.hi, *np.nextafter(a.lo, -9).tolist(), *np.nextafter(a.hi, 9).tolist()})
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", a.index(F.col("x")).alias("i")).collect()
    for r in got:
        assert r.i == next((i for i, (lo, hi) in enumerate(zip(a.lo, a.hi)) if lo <= r.x < hi), None)
    b = Axis.bounded("x", [(0, 1), (1, 3), (5, 9)])
    assert [r[0] for r in spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 2.9, 3.0, 5.0, 9.0)], "x double").select(b.index(F.col("x"))).collect()] == [N, 0, 1, 1, N, 2, N]


# collapse


def test_collapse_goldens(spark):
    g = grid_5x3(spark)
    dims = ["latitude_i", "longitude_i"]
    assert values(ag.collapse(g, ["v"], dims, ["longitude_i"], "mean"), "latitude_i") == [2, 5, 8, 11, 14]
    out = ag.collapse(g, ["v"], dims, ["latitude_i"], "moments").orderBy("longitude_i").collect()
    assert [(r.v, round(r.v_std_dev, 6), r.v_num_points) for r in out] == [(x, round(math.sqrt(22.5), 6), 5) for x in (7, 8, 9)]
    assert ag.collapse(g.withColumn("v", F.lit(None).cast("double")), ["v"], dims, dims, "moments").first().v_num_points == 0
    w = ag.collapse(g, ["v"], ["latitude", "longitude_i"], ["latitude"], "mean").orderBy("longitude_i").collect()
    assert [round(r.v, 6) for r in w] == [7, 8, 9]  # weights are even about the equator
    total = ag.collapse(g.withColumn("v", F.lit(1.0)), ["v"], ["latitude", "longitude"], ["latitude", "longitude"], "sum").first().v
    assert math.isclose(total, ag.AREA_RADIUS**2 * math.radians(15) * 2 * math.sin(math.radians(12.5)), rel_tol=1e-12)
    with pytest.raises(KeyError):
        ag.collapse(g, ["v"], dims, dims, "nonsense")


def test_spline_peak():
    x = np.arange(6)
    assert math.isclose(kernels.spline_peak(x * (5.0 - x)), 6.25, rel_tol=1e-9)
    assert kernels.spline_peak(np.array([3.0])) == 3 and kernels.spline_peak(np.array([])) is None and math.isclose(kernels.spline_peak(np.array([1.0, 2.0])), 2)


# subsetting


def test_subset_goldens(spark):
    p = pts_5x3(spark)
    diamond = "POLYGON ((-5.5 0, 0 5.5, 5.5 0, 0 -5.5, -5.5 0))"
    assert values(subset(p, shape=diamond), "row_id") == [5, 7, 8, 9, 11]
    assert values(subset(p, shape="POLYGON ((-5 -5, -5 5, 5 5, 5 -5, -5 -5))"), "row_id") == [8]  # the boundary is out
    assert values(subset(p, y=(0, 5), x=(0, None)), "row_id") == [8, 9, 11, 12]
    assert values(subset(p, latitude=(5,)), "row_id") == [10, 11, 12]
    line = spark.createDataFrame([(i + 1, DAY + i, float(i + 1)) for i in range(100)], "row_id int, time double, v double")
    start = tm.EPOCH + dt.timedelta(days=DAY)
    month = (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    got = values(subset(line, t=tm.PartialDateTime(month.year, month.month)), "row_id")
    assert got[0] == (month - start).days + 1 and len(got) in (28, 29, 30, 31)
    assert values(subset(lidar(spark), time=(DAY + 1, DAY + 2), altitude=(45, 75)), "row_id") == [27, 28, 32, 33, 37, 38]
    with pytest.raises(NoDataInSubsetError):
        require_rows(subset(p, y=(50, 60)))
    with pytest.raises(CoordinateNotFoundError):
        subset(p, z=(0, 1))


def test_subset_longitude_ranges(spark):
    p = pts(spark, (0,), range(-175, 146, 40))
    out = subset(p, x=(135, 270)).orderBy("row_id").collect()
    assert [(r.v, r.longitude) for r in out] == [(1, 185), (2, 225), (3, 265), (9, 145)]
    e = pts(spark, (0,), range(5, 326, 40))
    assert [(r.v, r.longitude) for r in subset(e, x=(-80, 10)).orderBy("row_id").collect()] == [(1, 5), (8, -75), (9, -35)]
    assert values(subset(p, x=(-100, 20)), "row_id") == [3, 4, 5]


def test_subset_grid(spark):
    g = grid_5x3(spark).drop("longitude_lo", "longitude_hi", "latitude_lo", "latitude_hi")
    assert values(subset_grid(g, ["v"], x=(0, 5)), "cell") == [2, 3, 5, 6, 8, 9, 11, 12, 14, 15]
    bounded = grid_5x3(spark)
    assert values(subset_grid(bounded, ["v"], y=(0, 0), x=(3, 5)), "cell") == [9]
    assert values(subset_grid(bounded, ["v"], y=(0, 0), x=(2.5, 5)), "cell") == [8, 9]  # its bound touches
    wide = Axis.of_points("longitude", range(-175, 146, 40), cyclic=True)
    w = spine(spark, [wide]).withColumn("v", (F.col("cell") + 1).cast("double")).drop("longitude_lo", "longitude_hi")
    assert values(subset_grid(w, ["v"], x=(135, 270)), "longitude") == [9, 1, 2, 3]
    assert values(subset_grid(g, ["v"], shape="POLYGON ((-1 -1, -1 6, 6 6, 6 -1, -1 -1))"), "cell") == [N] * 7 + [8, 9, N, 11, 12, N, N, N]


# collocation


def test_box_goldens(spark):
    s = samples(spark, [(1, 1), (3, 3), (-1, -1)])
    out = co.box(s, pts_5x3(spark), ["v"], h_sep=500).orderBy("sample_id").collect()
    assert [(round(r.v, 5), round(r.v_std_dev, 4), r.v_num_points) for r in out] == [(round(28 / 3, 5), 1.5275, 3), (10, 1.8257, 4), (round(20 / 3, 5), 1.5275, 3)]
    own = co.box(pts_5x3(spark).select(F.col("row_id").alias("sample_id"), "latitude", "longitude"), pts_5x3(spark), ["v"], h_sep=500).orderBy("sample_id").collect()
    assert [(r.v, r.v_std_dev, r.v_num_points) for r in own] == [(i, N, 1) for i in range(1, 16)]
    out = co.box(s, lidar(spark), ["v"]).first()
    assert (out.v, round(out.v_std_dev, 6), out.v_num_points) == (25.5, round(math.sqrt(212.5), 6), 50)
    five = ("latitude", "longitude", "altitude", "air_pressure", "time")
    near = co.pairs(samples(spark, [(0, 0, 50, 50, DAY + 2)], five), lidar(spark), h_sep=1000, a_sep=15, p_sep=1.22, t_sep=1 + 1 / 1440)
    assert values(near, "row_id") == [27, 28, 29, 32, 33, 34]
    assert values(co.pairs(samples(spark, [(0, 0, 50, 24, DAY)], five), lidar(spark), p_sep=2), "row_id") == list(range(6, 26))


def test_nearest_goldens(spark):
    s = samples(spark, [(1, 1), (4, 4), (-4, -4)])
    assert values(co.box(s, pts_5x3(spark), ["v"], "nn_h", h_sep=900), "sample_id") == [8, 12, 4]
    assert values(co.box(s, pts_5x3(spark), ["v"], "nn_horizontal_only"), "sample_id") == [8, 12, 4]
    t = samples(spark, [(0, 0, DAY + 2.1), (0, 0, DAY + 6.4), (0, 0, DAY + 8.9)], ("latitude", "longitude", "time"))
    assert values(co.box(t, pts_5x3(spark, days=True), ["v"], "nn_time", t_sep=100), "sample_id") == [3, 7, 10]


def test_missing_samples_and_fill(spark):
    s = samples(spark, [(1, 1), (60, 60)]).withColumn("have", F.when(F.col("sample_id") == 1, 1.0))
    out = co.box(s, pts_5x3(spark), ["v"], "mean", h_sep=500, missing_sample="have").orderBy("sample_id").collect()
    assert [r.v for r in out] == [N, N]
    assert values(co.box(s, pts_5x3(spark), ["v"], "mean", h_sep=500, fill_value=-9.0), "sample_id")[1] == -9


@pytest.mark.parametrize("h", [50.0, 450.0, 2000.0, 9000.0, 21000.0])
def test_distance_join_is_brute_force(spark, h):
    rng = np.random.default_rng(int(h))
    place = lambda n: [(math.degrees(math.asin(x)), y) for x, y in zip(rng.uniform(-1, 1, n), rng.uniform(-180, 180, n))]
    edge = [(90.0, 0.0), (-90.0, 10.0), (89.9, 179.9), (89.9, -179.9), (0.0, 180.0), (0.0, -180.0), (0.0, 179.99), (-89.99, 5.0), (45.0, -180.0)]
    s, d = place(60) + edge, place(250) + edge
    got = co.pairs(samples(spark, s), spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(d)], "k int, latitude double, longitude double"), h_sep=h).select("s_sample_id", "k").collect()

    def far(a, b):
        x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6378 * math.asin(math.sqrt(min(1, x)))

    want = {(i, k) for i, a in enumerate(s) for k, b in enumerate(d) if far(a, b) <= h}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_distance_join_is_an_equi_join(spark):
    p = pts_5x3(spark)
    plan = co.pairs(samples(spark, [(1, 1)]), p, h_sep=500)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# interpolation


def test_interpolation_goldens(spark):
    s = samples(spark, [(1, 1), (4, 4), (-4, -4), (20, 0)])
    g = grid_5x3(spark)
    got = values(ip.onto_points(s, g, ["v"], [LAT, LON]), "sample_id")
    assert got == [8.8, 11.2, 4.8, N]  # v = 8 + 3 lat / 5 + lon / 5
    assert values(ip.onto_points(s, g, ["v"], [LAT, LON], "nn"), "sample_id") == [8, 12, 4, N]
    assert values(ip.onto_points(s, g, ["v"], [LAT, LON], extrapolate=True), "sample_id")[3] == 20
    hole = grid_5x3(spark, missing=(5,))
    on_edge = samples(spark, [(-5, 5), (0, 0)])
    assert values(ip.onto_points(on_edge, hole, ["v"], [LAT, LON]), "sample_id") == [N, N]  # a missing corner of weight 0 too
    with pytest.raises(ValueError):
        ip.onto_points(s.drop("longitude"), g, ["v"], [LAT, LON])


def test_interpolation_in_four_dimensions(spark):
    names_ = ("a", "b", "c", "d")
    axes = [Axis.of_points(n, [0, 0.5, 1]) for n in names_]
    g = spine(spark, axes).withColumn("v", F.col("a") + 10 * F.col("b") + 100 * F.col("c") + 1000 * F.col("d"))
    s = samples(spark, [(0.1, 0.1, 1, 0.9), (0.2, 0.1, 0.45, 0.8), (0.5, 0.5, 0.5, 0.5)], names_)
    assert values(ip.onto_points(s, g, ["v"], axes), "sample_id") == [1001.1, 846.2, 555.5]
    far = samples(spark, [(-0.1, -0.1, -0.1, -0.1), (1.1, 1.1, 1.1, 1.1)], names_)
    assert values(ip.onto_points(far, g, ["v"], axes, extrapolate=True), "sample_id") == [-111.1, 1222.1]


def test_onto_grid_and_cyclic_longitude(spark):
    lon = Axis.of_points("longitude", range(0, 351, 10), cyclic=True)
    g = spine(spark, [lon]).withColumn("v", F.cos(F.radians("longitude")))
    s = samples(spark, [(355,), (-5,), (0,)], ("longitude",))
    a = (math.cos(math.radians(350)) + 1) / 2
    assert values(ip.onto_points(s, g, ["v"], [lon]), "sample_id") == [round(a, 6), round(a, 6), 1]
    target = [Axis.of_points("latitude", [-7.5, 7.5]), Axis.of_points("altitude", [1, 2])]
    out = ip.onto_grid(grid_5x3(spark), ["v"], [LAT, LON], target, extra_dims=["longitude_i"])
    assert values(out, ["cell", "longitude_i"]) == [2.5, 3.5, 4.5, 11.5, 12.5, 13.5]


def test_hybrid_levels(spark):
    levels = spine(spark, [LAT]).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("level"))).select("latitude_i", "level", (F.lit(100.0) * (4 - F.col("level")) + F.col("latitude_i")).alias("p"), F.col("level").cast("double").alias("v"))
    s = samples(spark, [(-10, 250), (0, 302), (0, 999), (10, 104)], ("latitude", "air_pressure"))
    got = values(ip.onto_points_hybrid(s, levels, ["v"], [LAT], level="level", vertical="p", at="air_pressure"), "sample_id")
    assert got == [1.5, 1, N, 3]


def test_bin_onto_unmatched_axes(spark):
    out = co.bin_onto(pts_5x3(spark), ["v"], [Axis.of_points("latitude", [-10, 0, 10]), Axis.of_points("altitude", [1, 2])], "mean")
    assert values(out, "cell") == [2, 6.5, 12.5]
    assert values(co.bin_onto(pts_5x3(spark), ["v"], [Axis.of_points("latitude", [-8, 0, 8]), LON], "nn_h"), "cell")[4] == 8


# expressions and arithmetic


def test_evaluate(spark):
    df = pts_5x3(spark).withColumn("w", F.col("v") + 10)
    assert values(ev.evaluate(df, "v + w"), "row_id", "calculated_variable") == list(range(12, 41, 2))
    out = lambda e, **kw: values(ev.evaluate(df, e, "out", **kw), "row_id", "out")
    assert out("v - numpy.mean(v)")[0] == -7 and out("max(v) - v")[0] == 14 and out("max(v, 8)")[0] == 8
    assert out("numpy.where(v > 8, 1, 0)") == [0] * 8 + [1] * 7
    assert out("v / (v - 1)")[0] is N and out("numpy.ma.masked_less(v, 3)")[:3] == [N, N, 3]
    assert out("-v ** 2")[2] == -9 and out("v % 4")[6] == 3 and out("v // 4")[6] == 1 and out("a * 2", aliases={"a": "v"})[0] == 2
    assert out("v if v > 2 else numpy.pi")[0] == 3.141593 and out("1 < v <= 3")[:4] == [False, True, True, False] and out("round(v / 2)")[:3] == [0, 1, 2]
    meta = ev.evaluate(df, "v * 2", "out", units="m").schema["out"].metadata
    assert meta["units"] == "m" and "v * 2" in meta["long_name"]
    for bad in ("numpy.mean(v)", "__import__('os')", "v.__class__", "open('x')", "nothing + 1", "[x for x in v]", "v +", "sorted(v)", "lambda: v", "'a'", "numpy.mean(numpy.mean(v)) + v", "numpy.sin(v, v, v)"):
        with pytest.raises(EvaluationError):
            ev.evaluate(df, bad)


def test_maths_units(spark):
    df = maths.with_units(maths.with_units(pts_5x3(spark).withColumn("w", F.col("v") - 1), "v", "m"), "w", "s")
    out = maths.divide(df, "v", "w", "q")
    assert maths.unit_of(out, "q") == "(m)/(s)" and values(out, "row_id", "q")[:2] == [N, 2]
    with pytest.raises(NotImplementedError):
        maths.add(df, "v", "w", "x")
    assert maths.unit_of(maths.exponentiate(df, "v", 2, "x"), "x") == "(m)^2" and maths.unit_of(maths.log(df, "v", "x", "10"), "x") == "lg(re m)"
    assert values(maths.absolute(maths.multiply(df, "w", "w", "x"), "x", "y"), "row_id", "y")[2] == 4


# statistics


def test_stats(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 12, 60).astype(float), rng.normal(size=60)
    rows = [(float(a), None if i % 9 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    keep = np.array([b is not None for _, b in rows])
    a, b = x[keep], y[keep]
    r = stats.stats(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    rank = lambda v: np.array([(v < k).sum() + ((v == k).sum() + 1) / 2 for k in v])
    slope, icpt = np.polyfit(a, b, 1)
    rr = np.corrcoef(a, b)[0, 1]
    rel = (b - a)[a != 0] / a[a != 0]
    want = [len(a), a.mean(), b.mean(), a.std(ddof=1), b.std(ddof=1), (b - a).mean(), (b - a).std(ddof=1), rel.mean(), rel.std(ddof=1), slope, icpt, rr, math.sqrt((1 - rr**2) * b.var(ddof=1) / a.var(ddof=1) / (len(a) - 2)), np.corrcoef(rank(a), rank(b))[0, 1]]
    assert np.allclose(list(r), want)


def test_histograms_and_taylor(spark):
    df = spark.createDataFrame([(float(i % 11), float(i % 3)) for i in range(33)], "x double, y double")
    assert [r.n for r in stats.histogram(df, "x").orderBy("bin").collect()] == [3] * 9 + [6]
    assert sum(r.n for r in stats.histogram2d(df, "x", "y").collect()) == 33
    t = {r.variable: r for r in stats.taylor(df, ["x", "y"]).collect()}
    assert (t["x"].gamma, t["x"].bias, round(t["x"].corr, 9)) == (1, 0, 1) and -1 <= t["y"].corr <= 1
    i = stats.info(df, ["x"]).first()
    assert (i.total, i.present, i.least, i.greatest) == (33, 33, 0, 10)


# functions


def test_time_functions(spark):
    assert tm.to_days(dt.datetime(2024, 1, 1)) == 154863.0
    assert tm.parse_duration("P1Y2M3DT4H5M6S") == dt.timedelta(days=428, hours=4, minutes=5, seconds=6) and tm.parse_duration("p1d:1m") == dt.timedelta(days=1, minutes=1)
    assert tm.PartialDateTime(2024, 2).range() == (dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 29, 23, 59, 59))
    assert tm.parse_datetime("2024-02-03T04").range() == (dt.datetime(2024, 2, 3, 4), dt.datetime(2024, 2, 3, 4, 59, 59))
    for bad in ("P", "1D", "PT"):
        with pytest.raises(ValueError):
            tm.parse_duration(bad)
    row = spark.range(1).select(tm.std_time(F.lit(dt.datetime(2024, 1, 1, 12))).alias("a"), tm.seconds_since(F.lit(43200.0), dt.datetime(1993, 1, 1)).alias("b"), tm.julian_days(F.lit(2460310.5)).alias("c"), tm.cf_time(F.lit(36.0), "hours since 2024-01-01 00:00:00").alias("d"), F.year(tm.to_timestamp(F.lit(154863.0))).alias("e"), tm.change_year(F.lit(dt.datetime(2024, 2, 29)), 2023).alias("f")).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (154863.5, tm.to_days(dt.datetime(1993, 1, 1)) + 0.5, 154863.0, 154864.5, 2024, None)


def test_decode(spark):
    x = F.col("x")
    df = spark.createDataFrame([(-999.0,), (1.0,), (5.0,), (float("nan"),)], "x double")
    got = lambda c: [r[0] for r in df.select(c).collect()]
    assert got(decode.fill(decode.no_nan(x), -999.0)) == [N, 1, 5, N] and got(decode.valid_range(decode.no_nan(x), 0, 4)) == [N, 1, N, N]
    assert got(decode.scale_cf(x, 2, 1))[1:3] == [3, 11] and got(decode.scale_modis(x, 2, 1))[1:3] == [0, 8] and got(decode.scale_caliop(x, 2, 1))[1] == 1.5 and got(decode.scale_cloudsat(x, 2, 1))[2] == 2
    assert got(decode.missing_where(x, "=>", 5))[1:3] == [1, N] and decode.parse_range("0.0...1.5") == (0, 1.5)
    track = spark.createDataFrame([(0, 0.0), (1, 10.0)], "i int, lat double").withColumn("granule", F.lit(1))
    assert [r.lat for r in decode.densify_track(track, "i", ["lat"], 5, ["granule"]).orderBy("i", "sub").collect()] == [-4, -2, 0, 2, 4, 6, 8, 10, 12, 14]


def test_units_names_geo(spark):
    assert units.parse_length("10km", "km") == 10 and units.parse_length("1.0e3m", "km") == 1 and units.parse_length(7, "m") == 7
    with pytest.raises(ValueError):
        units.parse_length("3s", "m")
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "lat_2 double, longitude double, v1 double").withMetadata("v1", {"standard_name": "altitude"})
    assert names.find_coordinate(df, "y") == "lat_2" and names.find_coordinate(df, "altitude") == "v1" and names.find_coordinate(df, "x") == "longitude"
    with pytest.raises(CoordinateNotFoundError):
        names.find_coordinate(df, "t")
    row = spark.range(1).select(geo.wrap_longitude(F.lit(-190.0), -180.0).alias("a"), geo.wrap_longitude(F.lit(360.0), 0.0).alias("b"), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("c")).first()
    assert (row.a, row.b) == (170, 0) and math.isclose(row.c, math.pi * 6378)


@pytest.mark.parametrize("kernel, c", [("nn_a", "altitude"), ("nn_p", "air_pressure"), ("nn_t", "time")])
def test_nearest_along_one_coordinate(spark, kernel, c):
    """Nearest kernels without a separation see every row; against all pairs."""
    rng = np.random.default_rng(4)
    data = [(i, *map(float, rng.integers(1, 40, 3)), None if i % 5 == 0 else float(i), None if i < 90 else float(-i)) for i in range(100)]
    d = spark.createDataFrame(data, "row_id int, altitude double, air_pressure double, time double, v double, u double")
    rows = [(i, *map(float, rng.integers(1, 60, 3) + rng.choice([0, 0.5], 3))) for i in range(40)] + [(40, N, N, N)]
    s = spark.createDataFrame(rows, "sample_id int, altitude double, air_pressure double, time double")
    k = {"altitude": 1, "air_pressure": 2, "time": 3}[c]
    far = (lambda a, b: max(a / b, b / a)) if c == "air_pressure" else lambda a, b: abs(a - b)
    got = {r.sample_id: (r.v, r.u) for r in co.box(s, d, ["v", "u"], kernel, row_id="row_id").collect()}
    for r in rows:
        want = tuple(min(((far(r[k], x[k]), x[0], x[j]) for x in data if x[j] is not N))[2] if r[k] is not N else N for j in (4, 5))
        assert got[r[0]] == want


def test_means_with_zeros_and_negatives(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 4.0), (1, 9.0), (2, 4.0), (2, 9.0), (3, -4.0), (3, 9.0), (4, N)], "g int, v double")
    for how, want in (("gmean", [0, 6, N, N]), ("hmean", [0, round(2 / (1 / 4 + 1 / 9), 6), N, N])):
        assert values(df.groupBy("g").agg(*kernels.data_only(how, ["v"])), "g") == want
