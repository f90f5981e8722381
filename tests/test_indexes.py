"""Polygons of many edges, long uneven axes and bundles of corners, against brute force."""

import math

import numpy as np
import pytest
from fixtures import LAT, LON, grid_5x3, samples
from pyspark.sql import functions as F

from skyweave.functions.geo import polygon_contains
from skyweave.operators import collocate as co
from skyweave.operators import interpolate as ip
from skyweave.operators.grid import FANOUT, Axis, locate, rank_in, spine
from skyweave.operators.polygon import index, mark_inside
from skyweave.operators.subset import subset, subset_grid


def star(n, inner=40.0, outer=60.0):
    """A ring of n points at two distances from 0, 0 in turn."""
    ring = [(r * math.cos(a), r * math.sin(a)) for k in range(n) for r, a in [((inner, outer)[k % 2], 2 * math.pi * k / n)]]
    return [[*ring, ring[0]]]


def steps(n):
    """A staircase on whole numbers: corners and edges that points lie on."""
    up = [p for k in range(n) for p in ((float(k), float(k)), (float(k + 1), float(k)))]
    ring = [*up, (float(n), float(n)), (0.0, float(n))]
    return [[*ring, ring[0]]]


HOLE = [(5.0, 20.0), (5.0, 30.0), (12.0, 30.0), (12.0, 20.0), (5.0, 20.0)]


@pytest.mark.parametrize("rings", [star(90), star(301, 3.0), steps(40), [*steps(40), HOLE]], ids=["star", "spikes", "stairs", "hole"])
def test_polygon_index_as_one_condition(spark, rings):
    xs = [x for r in rings for x, _ in r]
    ys = [y for r in rings for _, y in r]
    side = np.linspace(min(min(xs), min(ys)) - 1, max(max(xs), max(ys)) + 1, 61)
    # A lattice, the corners themselves, middles of edges, and points beside the corners.
    at = [(float(x), float(y)) for x in side for y in side] + [(float(x), float(y)) for x in range(0, 42) for y in range(0, 42)] + list(zip(xs, ys))
    at += [((a + c) / 2, (b + d) / 2) for r in rings for (a, b), (c, d) in zip(r, r[1:])] + [(x + 1e-9, y) for x, y in zip(xs, ys)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)] + [(-1, None, 1.0)], "i int, x double, y double").repartition(3)
    got = {r.i: r.inside for r in mark_inside(df, rings, "x", "y", "inside").collect()}
    assert len(got) == len(at) + 1 and got.pop(-1) is False
    # The same rule in numpy: edge by edge.
    e = np.array([(*p, *q) for r in rings for p, q in zip(r, r[1:])])
    for i, (x, y) in enumerate(at):
        a, b, c, d = e.T
        on = ((x - a) * (d - b) - (y - b) * (c - a) == 0) & (x >= np.minimum(a, c)) & (x <= np.maximum(a, c)) & (y >= np.minimum(b, d)) & (y <= np.maximum(b, d))
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = (y >= np.minimum(b, d)) & (y < np.maximum(b, d)) & (x < a + (y - b) * ((c - a) / (d - b)))
        assert got[i] == (cross.sum() % 2 == 1 and not on.any()), (x, y)


def test_polygon_of_20000_edges(spark):
    rings = star(20_000, 59.0)
    rows, _, n = index(rings)
    assert len(rows) <= n * n and max(len(r[4]) for r in rows) < 300 and any(not r[4] and r[2] for r in rows)
    rng = np.random.default_rng(5)
    at = rng.uniform(-65, 65, (3000, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "i int, longitude double, latitude double")
    wkt = "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in rings[0]) + "))"
    inside = {r.i for r in subset(df, shape=wkt).collect()}
    r = np.hypot(*at.T)
    assert {i for i in range(3000) if r[i] < 58.9} <= inside and not inside & {i for i in range(3000) if r[i] > 60}
    a, b, c, d = np.array([(*p, *q) for p, q in zip(rings[0], rings[0][1:])]).T
    for i, (x, y) in enumerate(at):
        if 58.9 <= r[i] <= 60 or i % 10 == 0:
            cross = (y >= np.minimum(b, d)) & (y < np.maximum(b, d)) & (x < a + (y - b) * ((c - a) / np.where(d == b, 1, d - b)))
            assert (i in inside) == (cross.sum() % 2 == 1)


def test_few_edges_and_grids_by_shape(spark):
    square = "POLYGON ((-6 -6, 6 -6, 6 6, -6 6, -6 -6))"
    many = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [(-6 + 12 * k / 50, -6) for k in range(50)] + [(6, -6 + 12 * k / 50) for k in range(50)] + [(6 - 12 * k / 50, 6) for k in range(50)] + [(-6, 6 - 12 * k / 50) for k in range(51)]) + "))"
    for shape in (square, many):
        out = {r.cell: r.v for r in subset_grid(grid_5x3(spark), ["v"], shape=shape).collect()}
        assert len(out) == 15 and {c for c, v in out.items() if v is not None} == set(range(3, 12))
    df = spark.createDataFrame([(0.0, 0.0), (7.0, 0.0), (6.0, 0.0)], "longitude double, latitude double")
    assert subset(df, shape=many).count() == subset(df, shape=square).count() == 1
    assert polygon_contains([HOLE], F.lit(6.0), F.lit(25.0)) is not None


def uneven(n, gaps=True):
    """Cells that grow with their number, a part of each step left open."""
    return [((k * k) / 2.0**20 - 90, (k * k + (k if gaps else 2 * k + 1)) / 2.0**20 - 90) for k in range(1, n + 1)]


def test_long_axes_by_brute_force(spark):
    bounds = uneven(3 * FANOUT + 17)
    a = Axis.bounded("latitude", bounds)
    lo, hi = np.array(a.lo), np.array(a.hi)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.uniform(-91, -88, 500), lo, hi, np.nextafter(lo, -100), [-1e9, 1e9]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "i int, latitude double")
    got = {r.i: r["at"] for r in locate(df, a, "at").collect()}
    assert got.pop(-1) is None
    for i, v in enumerate(x):
        k = int(np.searchsorted(lo, v, side="right")) - 1
        assert got[i] == (k if k >= 0 and v < hi[k] else None)
    for right in (True, False):
        out = rank_in(df.where("i >= 0"), a.lo, "latitude", "r", right=right, carry={"held": a.hi})
        for r in out.collect():
            k = int(np.searchsorted(lo, r.latitude, side="right" if right else "left"))
            assert (r.r, r.held) == (k, hi[max(k - 1, 0)])
    plan = locate(df, a, "at")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_three_levels_of_nodes(spark):
    edges = tuple(float(k * k) for k in range(FANOUT * FANOUT + 5))
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 0.5, 1, 65535.0**2, 65536.0**2 - 1, 65540.0**2, 1e12)], "x double")
    for r in rank_in(df, edges, "x", "r").collect():
        assert r.r == np.searchsorted(edges, r.x, side="right")


def test_bins_and_lines_on_a_long_axis(spark):
    a = Axis.bounded("latitude", uneven(2 * FANOUT))
    df = spark.createDataFrame([(float(a.lo[k]), float(k)) for k in (0, 5, 5, 300, 511)], "latitude double, v double")
    out = co.bin_onto(df, ["v"], [a], "sum")
    assert out.count() == 2 * FANOUT
    assert {r.latitude_i: (r.v, r.latitude_lo, r.latitude_hi) for r in out.where("v is not null").collect()} == {k: (v, a.lo[k], a.hi[k]) for k, v in ((0, 0.0), (5, 10.0), (300, 300.0), (511, 511.0))}
    line = Axis.of_points("altitude", [float(k) ** 1.5 for k in range(900)])
    g = spine(spark, [line]).withColumn("v", F.sqrt("altitude"))
    x = np.concatenate([np.random.default_rng(1).uniform(0, line.points[-1], 200), np.array(line.points)[[0, 1, 255, 256, 257, 899]], [-1.0, 1e9]])
    s = samples(spark, [(v,) for v in x], ("altitude",))
    got = {r.sample_id: r.v for r in ip.onto_points(s, g, ["v"], [line]).collect()}
    want = np.interp(x, line.points, np.sqrt(line.points))
    assert all((got[i] is None) if not 0 <= v <= line.points[-1] else abs(got[i] - want[i]) < 1e-9 for i, v in enumerate(x))


def test_one_join_and_no_grouping_of_samples(spark):
    s = samples(spark, [(1, 1), (1, 1), (4, 4)])
    twice = s.withColumn("sample_id", F.lit(7))  # keys need not be unique
    assert [r.v for r in ip.onto_points(twice, grid_5x3(spark), ["v"], [LAT, LON]).orderBy("latitude").collect()] == pytest.approx([8.8, 8.8, 11.2])
    plan = ip.onto_points(s, grid_5x3(spark), ["v"], [LAT, LON], "nn")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "Aggregate" not in plan
    plan = ip.onto_points(s, grid_5x3(spark), ["v"], [LAT, LON])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1  # of the grid's cells
