"""Trees of points: brute force, few opened pairs, dense places."""

import math

import numpy as np
import pytest

from skyweave.operators import collocate as co
from skyweave.operators import tree


def cloud(n, seed, dense=0.0, station=0):
    """(id, latitude, longitude, altitude, air_pressure, time, v): a share `dense` of them in one degree, `station` rows at one place."""
    rng = np.random.default_rng(seed)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    k = int(n * dense)
    lat[:k], lon[:k] = 50 + rng.uniform(0, 1, k), 8 + rng.uniform(0, 1, k)
    lat[:station], lon[:station] = 10.0, 179.999
    v = rng.normal(100, 10, n)
    v[rng.random(n) < 0.1] = np.nan
    return [(i, float(a), float(b), float(c), float(d), float(t), None if np.isnan(x) else float(x)) for i, a, b, c, d, t, x in zip(range(n), lat, lon, rng.uniform(0, 10000, n).round(-2), rng.uniform(100, 1000, n).round(), rng.uniform(0, 30, n), v)]


SCHEMA = "id bigint, latitude double, longitude double, altitude double, air_pressure double, time double, v double"


def distances(a, b):
    return tree.haversines(*(np.array([r[k] for r in x], float)[s] for x, s in ((a, (slice(None), None)), (b, (None, slice(None)))) for k in (1, 2)))


def near(a, b, **seps):
    col = lambda rows, k: np.array([np.nan if r[k] is None else r[k] for r in rows], float)
    out = np.ones((len(a), len(b)), bool)
    if "h_sep" in seps:
        out &= distances(a, b) <= seps["h_sep"]
    for name, k in (("a_sep", 3), ("t_sep", 5)):
        if name in seps:
            out &= np.abs(col(a, k)[:, None] - col(b, k)) < seps[name]
    if "p_sep" in seps:
        p, q = col(a, 4)[:, None], col(b, 4)
        out &= np.maximum(p / q, q / p) < seps["p_sep"]
    return out


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(tree, "LEAF_ROWS", 7)
    monkeypatch.setattr(tree, "TOGETHER", 3)
    for f in (tree.build, tree.box_sums, tree.nearest_in):
        monkeypatch.setitem(f.__kwdefaults__, "leaf_rows", 7)


SEPARATIONS = [{"h_sep": 900.0}, {"h_sep": 3000.0, "a_sep": 2500, "t_sep": 9}, {"t_sep": 2.5}, {"p_sep": 1.07}, {"h_sep": 0.0}, {"h_sep": 20000.0}, {"h_sep": 25000.0, "a_sep": 300}]


@pytest.mark.parametrize("seps", SEPARATIONS, ids=str)
def test_box_as_brute_force(spark, small_leaves, seps):
    a, b = cloud(90, 1, 0.3, 10), cloud(400, 2, 0.5, 40) + [(900, None, 1.0, None, None, None, 5.0), (901, 90.0, 0.0, 5.0, 500.0, 3.0, 7.0), (902, -90.0, 77.0, 5.0, 500.0, 3.0, float("nan"))]
    s, d = spark.createDataFrame(a, SCHEMA).drop("v").withColumnRenamed("id", "sample_id"), spark.createDataFrame(b, SCHEMA)
    v, there = np.array([np.nan if r[6] is None else r[6] for r in b], float), None
    there = near(a, [tuple(np.nan if x is None else x for x in r) for r in b], **seps) & ~np.isnan(v)
    more = (("sum", lambda x: (x.sum(),)), ("min", lambda x: (x.min(),)), ("RMS", lambda x: (np.sqrt((x * x).mean()),))) if "t_sep" in seps and "h_sep" in seps else ()
    for kernel, want in (("moments", lambda x: (x.mean(), x.std(ddof=1) if len(x) > 1 else None, len(x))), *more):
        names = co.kernels.output_names(kernel, ["v"])
        for r in co.box(s, d, ["v"], kernel, **seps).collect():
            x = v[there[r.sample_id]]
            w = want(x) if len(x) else (None,) * len(names)
            assert all((g is None) == (e is None) and (g is None or math.isclose(g, e, rel_tol=1e-9, abs_tol=1e-6)) for g, e in zip([r[n] for n in names], w)), (kernel, r)


@pytest.mark.parametrize("kernel", ["nn_h", "nn_a", "nn_p", "nn_t"])
def test_nearest_within_as_brute_force(spark, small_leaves, kernel):
    a, b = cloud(60, 3, 0.2, 5), [r for r in cloud(300, 4, 0.5, 60)]
    s, d = spark.createDataFrame(a, SCHEMA).drop("v").withColumnRenamed("id", "sample_id"), spark.createDataFrame(b, SCHEMA)
    inside, far = near(a, b, h_sep=2500.0), {"h": distances(a, b)}
    col = lambda rows, k: np.array([r[k] for r in rows], float)
    far |= {"a": np.abs(col(a, 3)[:, None] - col(b, 3)), "t": np.abs(col(a, 5)[:, None] - col(b, 5)), "p": np.maximum(col(a, 4)[:, None] / col(b, 4), col(b, 4) / col(a, 4)[:, None])}
    for r in co.box(s, d, ["v"], kernel, row_id="id", h_sep=2500.0).collect():
        ok = [(far[kernel[3]][r.sample_id, j], b[j][0], b[j][6]) for j in range(len(b)) if inside[r.sample_id, j] and b[j][6] is not None]
        assert r.v == (min(ok)[2] if ok else None)


def test_nearest_on_the_far_side(spark, small_leaves):
    """All samples are on the other hemisphere: most leaves of data are never opened, and no join is of all pairs."""
    b = [(i, 25 + abs(x[1]) * 0.7, *x[2:]) for i, x in enumerate(cloud(2500, 5)) if x[6] is not None]
    a = [(i, -25 - abs(x[1]) * 0.7, *x[2:]) for i, x in enumerate(cloud(300, 6))]
    s, d = spark.createDataFrame(a, SCHEMA).drop("v").withColumnRenamed("id", "sample_id"), spark.createDataFrame(b, SCHEMA)
    far = distances(a, b)
    rows, edges = tree.nearest_in(s, d, "v", "sample_id", "id", "h")
    got = {}
    for r in rows.collect():
        got[r.sample_id] = min(got.get(r.sample_id, (math.inf, 0, 0)), (r._far, r._rid, r.v))
    assert len(got) == 300 and all(math.isclose(got[i][0], far[i].min(), rel_tol=1e-12) for i in got)
    assert edges.count() < 0.5 * (300 / 7) * (len(b) / 7)
    assert "CartesianProduct" not in edges._jdf.queryExecution().toString() + rows._jdf.queryExecution().toString()


def test_dense_places_are_split(spark):
    """Nine tenths of the points in one degree, a fifth at one place: leaves have equal numbers of rows; most pairs are settled unopened."""
    rows = cloud(20_000, 7, 0.9, 4000)
    d = spark.createDataFrame(rows, SCHEMA)
    t = tree.build(d, ["id", "latitude", "longitude"], "h")
    sizes = sorted(r.n for r in t.leaves.select("n").collect())
    assert sum(sizes) == 20_000 and sizes[-1] == tree.LEAF_ROWS and sizes[len(sizes) // 2] == tree.LEAF_ROWS
    sums = tree.box_sums(d.withColumnRenamed("id", "sample_id"), d, ["v"], "sample_id", tree.Limits(h=500.0))
    opened = sums.pairs.where("NOT settled").count()
    inside = near(rows[::50], rows, h_sep=500.0) & np.array([r[6] is not None for r in rows])
    got = {r.sample_id: r.k for r in sums.rows.groupBy("sample_id").agg({"k_v": "sum"}).toDF("sample_id", "k").collect()}
    assert [got.get(r[0], 0) for r in rows[::50]] == inside.sum(1).tolist()
    # Pairs that are made, beside those that count.
    assert opened * tree.LEAF_ROWS**2 < 0.2 * inside.sum() * 50


def test_counts_of_several_radii(spark):
    a, b = cloud(500, 8, 0.5, 50), cloud(700, 9, 0.5, 100)
    radii = [0.0, 30.0, 700.0, 9000.0, 21000.0]
    far = distances(a, b)
    got, opened = tree.count_within(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), radii, leaf_rows=10)
    assert {r.radius: r.n for r in got.collect()} == {x: int((far <= x).sum()) for x in radii}
    assert opened.count() * 100 < sum(int((far <= x).sum()) for x in radii)
    none, _ = tree.count_within(spark.createDataFrame(a, SCHEMA).limit(0), spark.createDataFrame(b, SCHEMA), [5.0])
    assert [tuple(r) for r in none.collect()] == [(5.0, 0)]


@pytest.mark.parametrize("together", [3, 256])
def test_kernels_by_leaf_as_brute_force(spark, monkeypatch, together):
    """Kernels in Python, of a sample and of a leaf, medians and means of logarithms and reciprocals: leaves that meet few leaves, and ones that meet many."""
    monkeypatch.setattr(tree, "TOGETHER", together)
    monkeypatch.setitem(tree.by_leaf.__kwdefaults__, "leaf_rows", 7)
    a, b = cloud(60, 11, 0.4, 10), cloud(300, 12, 0.5, 40)
    s, d = spark.createDataFrame(a, SCHEMA).drop("v").withColumnRenamed("id", "sample_id"), spark.createDataFrame(b, SCHEMA)
    v, lat = np.array([np.nan if r[6] is None else r[6] for r in b], float), np.array([r[1] for r in b])
    inside = near(a, b, h_sep=2500.0, t_sep=12) & ~np.isnan(v)
    one = co.PythonKernel(lambda sample, m, c: ((m[c] * (m.latitude - sample["latitude"])).sum(), len(m)), ("", "_n"))
    batch = co.PythonKernel(lambda x, y, m, c: (np.where(m, y[c].fillna(0).to_numpy() * (y.latitude.to_numpy() - x.latitude.to_numpy()[:, None]), 0.0).sum(1), m.sum(1)), ("", "_n"), batch=True)
    seen = lambda i: (v[inside[i]] * (lat[inside[i]] - a[i][1])).sum()
    wants = {"one": lambda x, i: (seen(i), len(x)), "batch": lambda x, i: (seen(i), len(x)), "median": lambda x, i: (np.median(x),), "gmean": lambda x, i: (np.exp(np.log(x).mean()),), "hmean": lambda x, i: (1 / (1 / x).mean(),)}
    for kernel, want in wants.items():
        rows = co.box(s, d, ["v"], kernel, h_sep=2500.0, t_sep=12, user_kernels={"one": one, "batch": batch}).collect()
        assert len(rows) == 60
        for r in rows:
            x = v[inside[r.sample_id]]
            got = [r.v, r.v_n] if kernel in ("one", "batch") else [r.v]
            if len(x):
                assert np.allclose(got, want(x, r.sample_id), rtol=1e-9, atol=1e-6), (kernel, r)
            else:
                assert got[0] in (None, 0.0)
    rows, rest, few = tree.by_leaf(s, d, tree.Limits(h=2500.0), lambda x, y, m: __import__("pandas").DataFrame({"n": [len(x)]}), "n bigint")
    assert rows.count() == few.select("a").distinct().count()  # a call a leaf
    assert rest.isEmpty() == (together == 256)


def test_paired_keeps_types_and_nulls(spark):
    a, b = cloud(40, 13, 0.5, 5), cloud(200, 14, 0.5, 30)
    s = spark.createDataFrame(a, SCHEMA).selectExpr("id AS sample_id", "latitude", "longitude", "CASE WHEN id % 3 > 0 THEN 'é' || id END AS name")
    d = spark.createDataFrame(b, SCHEMA).selectExpr("id", "latitude", "longitude", "CASE WHEN id % 2 > 0 THEN cast(id AS int) END AS odd", "timestamp_seconds(id) AS at", "v")
    got = tree.paired(s, d, tree.Limits(h=1500.0), leaf_rows=7)
    assert got.schema["odd"].dataType.simpleString() == "int" and got.schema["at"].dataType.simpleString() == "timestamp"
    rows, inside = got.selectExpr("s_sample_id", "s_name", "id", "odd", "unix_seconds(at) AS at").collect(), near(a, b, h_sep=1500.0)
    assert sorted((r.s_sample_id, r.id) for r in rows) == sorted(zip(*(x.tolist() for x in np.nonzero(inside))))
    assert all(r.at == r.id and r.odd == (r.id if r.id % 2 else None) and r.s_name == (f"é{r.s_sample_id}" if r.s_sample_id % 3 else None) for r in rows)
    assert tree.paired(s.limit(0), d, tree.Limits(h=1500.0)).count() == 0


def test_nearest_k_opens_few_leaves(spark):
    """Data crowded in one degree, samples everywhere."""
    a, b = cloud(200, 15), cloud(3000, 16, 0.9, 300)
    far = distances(a, b)
    s, d = spark.createDataFrame(a, SCHEMA).withColumnRenamed("id", "sample_id"), spark.createDataFrame(b, SCHEMA).withColumnRenamed("id", "row_id")
    for h in (None, 1200.0):
        got = {}
        for r in co.nearest_k(s, d, 5, h_sep=h).collect():
            got.setdefault(r.sample_id, []).append((r["rank"], r.row_id, r.distance))
        for i in range(200):
            want = sorted((x, j) for j, x in enumerate(far[i]) if h is None or x <= h)[:5]
            mine = sorted(got.get(i, []))
            assert [x[0] for x in mine] == list(range(1, len(want) + 1)) and np.allclose([x[2] for x in mine], [x for x, _ in want])
    assert co.nearest_k(s.limit(0), d, 5).count() == 0 and co.nearest_k(s, d.limit(0), 5).count() == 0
    # With four times the points on both sides, a leaf of samples opens about as many leaves as before.
    opened = []
    for n in (600, 2400):
        s, d = (spark.createDataFrame(cloud(m, 16), SCHEMA).withColumnRenamed("id", name) for m, name in ((n, "sample_id"), (5 * n, "row_id")))
        _, edges = tree.nearest_k(s, d, 5, "sample_id", "row_id", leaf_rows=10)
        opened.append(edges.count() / (n / 10))
    assert opened[1] < 1.5 * opened[0]
