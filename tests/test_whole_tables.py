"""Queries that take every event as a point, against brute force without Spark's joins or the SQL."""

import numpy as np

from skyweave.operators import collocate as co
from skyweave.operators.collocate import EARTH_RADIUS
from skyweave.plans import catalogue as cat

SF = "/root/testdata/sf0.001"


def places(spark):
    p = cat.points(spark, SF).select("event_id", "latitude", "longitude").toPandas().sort_values("event_id")
    return p.event_id.to_numpy(), np.radians(p.latitude.to_numpy()), np.radians(p.longitude.to_numpy())


def distances(lat, lon):
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def test_neighbour_counts_of_every_event(spark):
    ids, lat, lon = places(spark)
    near = np.triu(distances(lat, lon) <= 403.3, 1)
    want = {int(i): int(n) for i, n in zip(ids, near.sum(1)) if n}
    assert any(i % 10 for i in want)
    assert {r.a: r.n for r in cat.QUERIES["neighbour_counts"](spark, SF).collect()} == want


def test_every_event_is_a_sample(spark):
    """Of each query of samples: a row an event. Five of them by brute force."""
    ids, lat, lon = places(spark)
    names = [n for n in cat.QUERIES if n.startswith(("box_", "nn_", "lin_")) and not n.endswith(("onto_grid", "grid_to_grid"))]
    assert len(names) == 19
    got = {n: {r.sample_id: r for r in cat.QUERIES[n](spark, SF).collect()} for n in names}
    assert all(set(rows) == set(ids.tolist()) for rows in got.values())
    v = cat.points(spark, SF).select("event_id", "v_m").toPandas().sort_values("event_id").v_m.to_numpy(float)
    far, there = distances(lat, lon), ~np.isnan(v)
    for i, e in enumerate(ids.tolist()):
        near = v[there & (far[i] <= 777.7)]
        mean, nearest = got["box_h_mean"][e].v_m, v[there][far[i][there].argmin()]
        assert abs(mean - near.mean()) < 1e-6 if len(near) else mean is None
        assert abs(got["nn_horizontal_only"][e].v - nearest) < 1e-6
    p = cat.points(spark, SF).select("event_id", "altitude", "air_pressure", "time").toPandas().sort_values("event_id")
    for name, column in (("nn_a_any", "altitude"), ("nn_p_any", "air_pressure"), ("nn_t_any", "time")):
        x = p[column].to_numpy(float)
        away = np.maximum(x[:, None] / x, x / x[:, None]) if column == "air_pressure" else np.abs(x[:, None] - x)
        first = np.where(there, away, np.inf).argmin(1)  # events are in order, so the first of equal ones has the least id
        assert all(abs(got[name][e].v_m - v[j]) < 1e-6 for e, j in zip(ids.tolist(), first))


def test_nearest_of_each_variable(spark):
    """A variable that is missing near a sample is found farther out; one without any value stays NULL."""
    p = cat.points(spark, SF).selectExpr("event_id", "latitude", "longitude", "v", "CASE WHEN event_id % 250 = 0 THEN w END AS u", "CAST(NULL AS double) AS none")
    samples = cat.samples(cat.points(spark, SF)).where("sample_id in (1, 77, 333, 500, 901)")
    ids, lat, lon = places(spark)
    far, rows = distances(lat, lon), p.toPandas().sort_values("event_id")
    for r in co.nearest(samples, p, ["v", "u", "none"], row_id="event_id").collect():
        d = far[list(ids).index(r.sample_id)]
        for c in ("v", "u"):
            x = rows[c].to_numpy(float)
            assert r[c] == x[np.where(np.isnan(x), np.inf, d).argmin()]
        assert r.none is None


def test_col_peak_as_brute_force(spark):
    """The greatest value of the not-a-knot spline through each row of cells: as one system for all coefficients of its cubics."""
    g = cat.grid(spark, SF).toPandas().sort_values("longitude_i")
    got = {r.latitude_i: r.v for r in cat.QUERIES["col_peak"](spark, SF).collect()}
    assert len(got) == 18
    for lat, rows in g.groupby("latitude_i"):
        y = rows.v.dropna().to_numpy(float)
        n = len(y)
        if n < 4:
            continue
        a, b, k = np.zeros((4 * (n - 1), 4 * (n - 1))), np.zeros(4 * (n - 1)), 0
        power = lambda x, d: [np.prod([p - j for j in range(d)]) * x ** (p - d) if p >= d else 0.0 for p in range(4)]
        for i in range(n - 1):
            for x, v in ((0.0, y[i]), (1.0, y[i + 1])):
                a[k, 4 * i : 4 * i + 4], b[k], k = power(x, 0), v, k + 1
        for i in range(n - 2):
            for d in (1, 2) + ((3,) if i in (0, n - 3) else ()):
                a[k, 4 * i : 4 * i + 4] = power(1.0, d)
                a[k, 4 * i + 4 : 4 * i + 8] = [-x for x in power(0.0, d)]
                k += 1
        c = np.linalg.lstsq(a, b, rcond=None)[0].reshape(n - 1, 4)
        want = max((np.array([u**p for p in range(4)]) @ c[i]) for i in range(n - 1) for u in np.linspace(0, 1, 101))
        assert abs(got[lat] - want) < 1e-6
