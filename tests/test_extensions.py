"""Extracted products, plugins, plot data, and what datasets and the command line make of them."""

import datetime as dt

import numpy as np
import pytest
from fixtures import grid_5x3, lidar, pts_5x3, samples
from pyspark.sql import functions as F

from skyweave import cli, plugins
from skyweave.dataset import Dataset, get_variables, read_data_list
from skyweave.errors import ClassNotFoundError, CoordinateNotFoundError, InconsistentDimensionsError, InvalidCommandLineOptionError, InvalidDataTypeError
from skyweave.functions import decode, geo
from skyweave.functions import time as tm
from skyweave.operators import aggregate as ag
from skyweave.operators import collocate as co
from skyweave.operators import evaluate as ev
from skyweave.operators import maths, plotdata, stats
from skyweave.operators.grid import Axis
from skyweave.sources import PRODUCTS, read, sinks
from skyweave.sources.products import find_product

DAY0 = lambda *a: tm.to_days(dt.datetime(*a))


@pytest.fixture()
def extract(spark, tmp_path):
    """extract(name, schema, rows, attributes): a file's dumped datasets."""

    def go(name, schema, rows, attributes=()):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/values")
        spark.createDataFrame([tuple(map(str, a)) for a in attributes] or [("", "x", "y")], "variable string, key string, value string").write.parquet(f"{path}/attributes")
        return path

    return go


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_cloudsat(spark, extract):
    p = extract("2008_CS_2B-GRANULE_x.hdf", "Longitude double, Latitude double, Height int, TAI_start double, Profile_time double, RO int", [(1.0, 2.0, 100, 86400.0, 43200.0, 520), (1.0, 2.0, 200, 86400.0, 43200.0, -7)], [("RO", "factor", 10), ("RO", "offset", 20), ("RO", "missing", 0), ("RO", "missop", "<"), ("RO", "units", "mm")])
    df = read(spark, p, "RO")
    assert rows_of(df.select("longitude", "altitude", "time", "RO")) == [(1.0, 100.0, DAY0(1993, 1, 2, 12), 50.0), (1.0, 200.0, DAY0(1993, 1, 2, 12), None)]
    assert df.schema["RO"].metadata["units"] == "mm"


def test_modis(spark, extract):
    p = extract("MYD04_L2.A2010.hdf", "Longitude float, Latitude float, Scan_Start_Time double, Depth int, Bands array<int>", [(1.0, 2.0, 0.0, 150, [1, 2]), (3.0, 4.0, 86400.0, -9999, [3, 500])], [("Depth", "scale_factor", 0.01), ("Depth", "add_offset", 50), ("Depth", "_FillValue", -9999), ("Bands", "valid_range", "0, 100")])
    df = read(spark, p, "*")
    assert df.columns == ["latitude", "longitude", "time", "Depth", "Bands_0", "Bands_1"]
    assert rows_of(df.select("time", "Depth", "Bands_0", "Bands_1")) == [(DAY0(1993, 1, 1), 1.0, 1.0, 2.0), (DAY0(1993, 1, 2), None, 3.0, None)]
    p = extract("MOD08_D3.A2010.hdf", "XDim double, YDim double, AOD int", [(0.5, 1.5, 7)], [("", "RANGEBEGINNINGDATE", "2010-01-01"), ("", "RANGEBEGINNINGTIME", "00:00:00.000000"), ("", "RANGEENDINGDATE", "2010-01-03"), ("", "RANGEENDINGTIME", "00:00:00.000000")])
    assert rows_of(read(spark, p, "AOD").select("longitude", "latitude", "time", "AOD")) == [(0.5, 1.5, DAY0(2010, 1, 2), 7.0)]


def test_caliop(spark, extract):
    schema = "Longitude array<double>, Latitude array<double>, Profile_Time array<double>, Lidar_Data_Altitudes double, Pressure double, Ext double, CAD_Score array<int>"
    rows = [([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [0.0, 43200.0, 0.0], 9.0, 500.0, 30.0, [7, 8]), ([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [0.0, 43200.0, 0.0], 9.5, 490.0, -9999.0, [9, 8])]
    a = [("Ext", "format", "Float_32"), ("Ext", "scale_factor", 10), ("Ext", "add_offset", 1), ("Ext", "valid_range", "0...50")]
    p = extract("CAL_LID_L2_05kmAPro-Prov.hdf", schema, rows, a)
    df = read(spark, p, ["Ext", "CAD_Score"])
    assert rows_of(df.select("longitude", "latitude", "time", "air_pressure", "Ext", "CAD_Score")) == [(2.0, 5.0, DAY0(1993, 1, 1, 12), 490.0, None, 9.0), (2.0, 5.0, DAY0(1993, 1, 1, 12), 500.0, 4.0, 7.0)]
    assert "air_pressure" not in read(spark, p, "Ext", product="Caliop_L2_NO_PRESSURE").columns
    p = extract("CAL_LID_L1-x.hdf", schema, rows, a)
    assert {r.latitude for r in read(spark, p, "Ext").collect()} == {4.0}


def test_cci(spark, extract):
    jd = 2305447.5
    for name, stored, want in (("x-ESACCI-L2_CLOUD-y.nc", jd + 10, 10.0), ("x-ESACCI-L2P_AEROSOL-y.nc", 86400.0, DAY0(1970, 1, 2))):
        p = extract(name, "lon double, lat double, time double, cot int", [(1.0, 2.0, stored, 4)], [("cot", "scale_factor", 0.5), ("cot", "add_offset", 1)])
        assert rows_of(read(spark, p, "cot").select("longitude", "time", "cot")) == [(1.0, want, 3.0)]
    for name in ("200801-ESACCI-L3C_CLOUD-x.nc", "200802-ESACCI-L3C_AEROSOL-x.nc"):
        p = extract(name, "lon double, lat double, aod double", [(1.0, 2.0, 0.5)], [("", "time_coverage_start", "20080201T000000Z"), ("", "time_coverage_end", "20080244T000000Z")])
        assert rows_of(find_product(spark, p).scan(spark, [p]).select("time")) == [((DAY0(2008, 2, 1) + DAY0(2008, 2, 29)) / 2,)]


def test_other_netcdf(spark, extract):
    flight = extract("flight.nc", "LONC double, LATC double, Time double, T double", [(1.0, 2.0, 3600.0, 280.0)], [("", "Conventions", "NCAR-RAF/nimbus"), ("Time", "units", "seconds since 2001-01-01 00:00:00")])
    assert rows_of(read(spark, flight, "T").select("longitude", "time", "T")) == [(1.0, DAY0(2001, 1, 1, 1), 280.0)]
    station = extract("station.nc", "time double, bc double", [(0.5, 9.0)], [("", "GASSP_Version", "1"), ("", "Station_Lat", "45.5N"), ("", "Station_Lon", "10W"), ("", "Station_Altitude", "120 m"), ("time", "units", "days since 2000-01-01")])
    assert rows_of(read(spark, station, "bc").select("latitude", "longitude", "altitude", "time", "bc")) == [(45.5, -10.0, 120.0, DAY0(2000, 1, 1, 12), 9.0)]
    grid = extract("grid.nc", "longitude double, latitude double, time double, geopotential double, q double", [(1.0, 2.0, 0.0, 98.0665, -1.0)], [("time", "units", "hours since 1600-01-02"), ("q", "missing_value", -1)])
    assert find_product(spark, grid).name == "NetCDF_Gridded"
    assert [(r.altitude, r.time, r.q) for r in read(spark, grid, "q").collect()] == [(pytest.approx(10.0), 1.0, None)]
    for name in ("xabcde.pa20080101.nc", "run.pp"):
        p = extract(name, "longitude double, latitude double, t double, a double, b double, orog double, u double", [(1.0, 2.0, 5.0, 100.0, 0.5, 40.0, 3.0)])
        assert find_product(spark, p).name in ("HadGEM_CONVSH", "HadGEM_PP") and rows_of(read(spark, p, "u").select("altitude", "time", "u")) == [(120.0, 5.0, 3.0)]


def test_earthcare(spark, extract):
    p = extract("ECA_MSI_RGR_1C_x.h5", "longitude double, latitude double, time double, pixel_values array<double>", [(1.0, 2.0, 86400.0, [5.0, 6.0, 7.0])], [("pixel_values", "dimension", "band")])
    df = read(spark, p, "pixel_values*")
    assert df.columns[-4:] == ["pixel_values", "pixel_values_BANDNUM_0", "pixel_values_BANDNUM_1", "pixel_values_BANDNUM_2"]
    assert rows_of(df.select("time", "pixel_values", "pixel_values_BANDNUM_2")) == [(DAY0(2000, 1, 2), 5.0, 7.0)]
    assert len(PRODUCTS) >= 17


def test_aeronet_headers(spark, tmp_path):
    head = "AERONET Version 3; SDA\nsite\nVersion 3\nx\ny\nz\n"
    (tmp_path / "a.ONEILL_lev20").write_text(head + "AERONET_Site,Date_(dd:mm:yyyy),Time_(hh:mm:ss),Site_Latitude(Degrees),Site_Longitude(Degrees),Site_Elevation(m),AOD,AOD,Number_of_Wavelengths,Exact_Wavelengths_for_Input_AOD(um)\nRome,01:02:2010,12:00:00,41.8,12.6,130,0.5,-999.,3,0.4,0.5,0.6\n")
    df = read(spark, f"{tmp_path}/a.ONEILL_lev20", "*")
    r = df.collect()
    assert [(x.latitude, x.altitude, x.time, x.AOD0, x.AOD1) for x in r] == [(41.8, 130.0, DAY0(2010, 2, 1, 12), 0.5, None)]
    assert [r[0][c] for c in df.columns if c.startswith("Exact")] == [0.4, 0.5, 0.6]
    (tmp_path / "m.all").write_text("Maritime Aerosol Network (MAN) Data\na\nb\nc\nDate(dd-mm-yyyy),Time(hh:mm:ss),Latitude,Longitude,AOD\n03-02-2010,06:00:00,1.5,2.5,0.25\n")
    assert rows_of(read(spark, f"{tmp_path}/m.all", "AOD")) == [(1.5, 2.5, 0.0, DAY0(2010, 2, 3, 6), 0.25)]


def test_get_variables_rules(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0, 3.0, [1.0], "x")], "latitude double, longitude double, v double, spectrum array<double>, flag string").write.parquet(f"{tmp_path}/t.parquet")
    assert get_variables(spark, f"{tmp_path}/t.parquet") == ["v", "flag"] and get_variables(spark, f"{tmp_path}/t.parquet", type="double") == ["v"]


def test_plot_data(spark):
    p = pts_5x3(spark)
    assert plotdata.scatter2d(p, "v").count() == 15 and [r.y for r in plotdata.line(lidar(spark), "v", "altitude").limit(1).collect()] != []
    pairs, ends = plotdata.comparative_scatter(lidar(spark), "v", "altitude")
    assert pairs.count() == 50 and rows_of(ends) == [(0.0, 0.0), (90.0, 90.0)]
    axes = [Axis.regular("longitude", -180, 180, 90), Axis.regular("latitude", -90, 90, 90)]
    g = ag.aggregate(p, ["v"], "mean", {"x": (-180, 180, 90), "y": (-90, 90, 90)})
    m = plotdata.mesh(g, "v", axes)
    assert m.count() == 5 * 2 and m.where("x = 225 and x_lo = 180").count() == 2
    assert [round(r.v, 6) for r in plotdata.contour_levels(p, "v").orderBy("level").collect()] == [round(1 + 14 * i / 6, 6) for i in range(7)]
    fig = Dataset(g, ("v",), tuple(axes)).figure("contourf")
    assert set(fig) == {"mesh", "levels"}
    for kind in ("line", "scatter", "scatter2d", "histogram"):
        assert all(t.count() for t in Dataset(p.withColumn("time", F.col("row_id").cast("double")), ("v",)).figure(kind).values())
    with pytest.raises(InvalidCommandLineOptionError):
        plotdata.figure("cake", p, ["v"])


def test_plugins(spark, tmp_path):
    (tmp_path / "mine.py").write_text(
        "from pyspark.sql import functions as F\n"
        "from skyweave import plugins\n"
        "@plugins.kernel('spread')\n"
        "def spread(v):\n    return [(F.max(v) - F.min(v)).alias(v)]\n"
        "@plugins.kernel('below')\n"
        "def below(v):\n    return [F.count(F.when(F.col('latitude') < F.col('s_latitude'), F.col(v))).cast('double').alias(v)]\n"
        "@plugins.python_kernel('weighted', ('', '_n'))\n"
        "def weighted(sample, matches, v):\n    w = 1 / (1 + (matches.latitude - sample['latitude']) ** 2)\n    return (w * matches[v]).sum() / w.sum(), len(matches)\n"
        "@plugins.constraint('north')\n"
        "def north():\n    return F.col('latitude') >= F.col('s_latitude')\n"
    )
    assert plugins.discover(str(tmp_path)) == ["mine"]
    s, d = samples(spark, [(0, 0), (80, 0)]), pts_5x3(spark)
    got = lambda **o: [tuple(r) for r in plugins.collocate(s, d, ["v"], h_sep=800, **o).orderBy("sample_id").drop("latitude", "longitude").collect()]
    assert got(kernel="spread") == [(0, 8.0), (1, None)] and got(kernel="below") == [(0, 3.0), (1, None)]
    near = [(v, lat) for v, lat, lon in ((3 * i + j + 1.0, -10 + 5 * i, -5 + 5 * j) for i in range(5) for j in range(3)) if abs(lat) <= 5]
    w = [1 / (1 + lat**2) for _, lat in near]
    assert got(kernel="weighted")[0] == (0, pytest.approx(sum(a * v for a, (v, _) in zip(w, near)) / sum(w)), 9.0)
    assert got(kernel="min", constraint="north") == [(0, 7.0), (1, None)]
    assert plugins.collocate(s, d, ["v"], "dummy") is d
    with pytest.raises(ClassNotFoundError):
        plugins.collocate(s, d, ["v"], "none")
    with pytest.raises(InvalidCommandLineOptionError):
        co.box(s, d, ["v"], "mean", where=F.lit(True))


def test_salted_pairs_are_the_same(spark):
    d = spark.createDataFrame([(i, 0.01 * (i % 3), 0.0, float(i)) for i in range(200)], "row_id int, latitude double, longitude double, v double")
    s = samples(spark, [(0, 0), (0.02, 0.01), (9, 9)])
    one, many = (rows_of(co.box(s, d, ["v"], "moments", h_sep=50, salts=n).withColumns({c: F.round(c, 9) for c in ("v", "v_std_dev")})) for n in (1, 7))
    assert one == many and one[0][-1] == 200


def test_tree_operations(spark):
    rng = np.random.default_rng(8)
    place = lambda n: [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, n), rng.uniform(-180, 180, n))]
    a, b = place(15), place(120)
    s, d = samples(spark, a), spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "row_id int, latitude double, longitude double")
    far = lambda p, q: 2 * 6378 * np.arcsin(np.sqrt(np.sin(np.radians(q[0] - p[0]) / 2) ** 2 + np.cos(np.radians(p[0])) * np.cos(np.radians(q[0])) * np.sin(np.radians(q[1] - p[1]) / 2) ** 2))
    whole = {(i, j): far(p, q) for i, p in enumerate(a) for j, q in enumerate(b)}
    assert {(r.sample_id, r.row_id) for r in co.within(s, d, 3000).collect()} == {k for k, x in whole.items() if x <= 3000}
    assert {(r.sample_id, r.row_id): pytest.approx(r.distance) for r in co.within(s, d, 20_100).collect()} == whole
    got = {(r.sample_id, r.rank): r.row_id for r in co.nearest_k(s, d, 3).collect()}
    assert got == {(i, k + 1): j for i in range(15) for k, j in enumerate(sorted(range(120), key=lambda j: whole[i, j])[:3])}
    few = co.nearest_k(s, d, 3, h_sep=1500)
    assert {(r.sample_id, r.row_id) for r in few.collect()} == {(i, j) for i in range(15) for j in sorted(range(120), key=lambda j: whole[i, j])[:3] if whole[i, j] <= 1500}
    assert co.nearest_k(s, d.limit(0), 3).count() == 0


def test_dataset_verbs(spark, tmp_path):
    data = Dataset(pts_5x3(spark), ("v",))
    assert data.copy() == data and sorted(r.row_id for r in data[3:6].df.collect()) == [3, 4, 5]
    with pytest.raises(InvalidDataTypeError):
        Dataset(data.df.drop("row_id"), ("v",))[1:2]
    double = data.with_same_coordinates("twice", F.col("v") * 2, "m")
    assert double.variables == ("twice",) and double.df.agg(F.sum("twice")).first()[0] == 240
    assert {(r.variable, r.present, r.units, r.coordinates) for r in double.describe().collect()} == {("twice", 15, "m", "latitude, longitude")}
    with pytest.raises(CoordinateNotFoundError):
        Dataset(spark.range(3).toDF("k"), ()).sampled_from(data, h_sep=5)
    g = ag.aggregate(pts_5x3(spark), ["v"], "mean", {"y": (-12.5, 12.5, 5)})
    axes = [Axis.regular("latitude", -12.5, 12.5, 5)]
    sinks.save_grid(g, axes, f"{tmp_path}/g")
    again = read_data_list(spark, f"{tmp_path}/g", "v")
    assert again.gridded and again.axes[0].points == axes[0].points and again.df.count() == 5
    at = Dataset(samples(spark, [(2.5, 0), (50, 0)]), ()).sampled_from(again)
    assert [r.v for r in at.df.orderBy("sample_id").collect()] == [9.5, None]
    assert sinks.warn_of_space(g, f"{tmp_path}/x") is None and sinks.human_size(1_500_000) == "1.5 MB"


def test_command_line_more(spark, tmp_path, capsys):
    go = lambda *a: cli.main(list(a), spark)
    (tmp_path / "p.csv").write_text("latitude,longitude,rain\n" + "".join(f"{r.latitude},{r.longitude},{r.v}\n" for r in pts_5x3(spark).collect()))
    (tmp_path / "q.csv").write_text("latitude,longitude,wind\n" + "".join(f"{r.latitude},{r.longitude},{2 * r.v}\n" for r in pts_5x3(spark).collect()))
    g = ag.aggregate(pts_5x3(spark), ["v"], "mean", {"y": (-12.5, 12.5, 5)})
    sinks.save_grid(g, [Axis.regular("latitude", -12.5, 12.5, 5)], f"{tmp_path}/g")
    assert go("col", f"v:{tmp_path}/g", f"{tmp_path}/p.csv:nn", "-o", f"{tmp_path}/nn") == 0
    assert sorted({r.v for r in spark.read.parquet(f"{tmp_path}/nn").collect()}) == [2, 5, 8, 11, 14]
    assert go("col", f"v:{tmp_path}/g", f"{tmp_path}/p.csv:lin[extrapolate=True]", "-o", f"{tmp_path}/lin") == 0
    assert go("col", f"rain:{tmp_path}/p.csv", f"{tmp_path}/g:bin,kernel=max", "-o", f"{tmp_path}/bin") == 0
    assert sorted(r.rain for r in spark.read.parquet(f"{tmp_path}/bin/cells").collect()) == [3, 6, 9, 12, 15]
    assert go("col", f"v:{tmp_path}/g", f"{tmp_path}/p.csv:lin,kernel=max", "-o", f"{tmp_path}/no") == 1
    both = ag.aggregate(pts_5x3(spark), ["v"], "mean", {"y": (-12.5, 12.5, 5), "x": (-7.5, 7.5, 5)})
    sinks.save_grid(both, [Axis.regular("latitude", -12.5, 12.5, 5), Axis.regular("longitude", -7.5, 7.5, 5)], f"{tmp_path}/yx")
    assert go("collapse", f"v:{tmp_path}/yx:kernel=max", "x", "-o", f"{tmp_path}/col") == 0
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/col/cells").collect()) == [3, 6, 9, 12, 15]
    assert go("subset", f"v:{tmp_path}/yx", "y=[-1,1]", "-o", f"{tmp_path}/sub") == 0 and go("plot", f"v:{tmp_path}/yx", "--type", "heatmap", "-o", f"{tmp_path}/hm") == 0
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/sub/cells").collect()) == [7, 8, 9] and spark.read.parquet(f"{tmp_path}/hm/mesh").count() == 15
    assert go("eval", f"rain:{tmp_path}/p.csv", f"wind:{tmp_path}/q.csv", "wind - rain", "mm", "-o", f"d:{tmp_path}/ev") == 0
    assert sorted(r.d for r in spark.read.parquet(f"{tmp_path}/ev").collect()) == list(range(1, 16))
    assert go("plot", f"rain:{tmp_path}/p.csv", f"wind:{tmp_path}/q.csv", "--type", "comparativescatter", "-o", f"{tmp_path}/fig") == 0
    assert spark.read.parquet(f"{tmp_path}/fig/points").count() == 15
    assert go("plot", f"rain:{tmp_path}/p.csv", "--type", "scatter2d", "-o", f"{tmp_path}/fig2") == 0 and go("info", f"rain:{tmp_path}/p.csv") == 0
    assert "latitude, longitude" in capsys.readouterr().out


def test_small_functions(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, float("nan"), float("nan")), (3, None, None), (4, 1.0, 2.0), (5, None, 1.0)], "k int, a double, b double")
    assert [r[0] for r in df.orderBy("k").select(decode.equal_including_missing(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]
    assert decode.same_values(df.where("k < 4"), df.where("k < 4").withColumnRenamed("b", "c"), "k", "a") and not decode.same_values(df, df.where("k > 1"), "k", "a")
    assert stats.bin_edges(df.where("k = 1 OR k = 4"), "b", 2) == [1.0, 1.5, 2.0] and stats.bin_edges(spark.createDataFrame([(1.0,), (100.0,)], "x double"), "x", 2, log=True) == pytest.approx([1, 10, 100])
    with pytest.raises(InconsistentDimensionsError):
        maths.side_by_side(df, df.unionByName(df), ["k"])
    assert maths.side_by_side(df, df.select("k", F.col("b").alias("c")), ["k"]).count() == 5
    assert tm.parse_datetime("2010/03/04") == tm.PartialDateTime(2010, 3, 4) == tm.parse_datetime("4 Mar 2010") == tm.parse_datetime("20100304")
    assert tm.parse_number_or_days("P1DT12H") == 1.5 and tm.parse_number_or_days("2") == 2 and tm.parse_number_or_datetime("3.5") == 3.5
    at = lambda lat, lon: {"latitude": F.lit(lat), "longitude": F.lit(lon)}
    r = spark.range(1).select(geo.nearer("h", at(0.0, 0.0), at(1.0, 1.0), at(2.0, 2.0)).alias("n"), geo.same_place(at(0.0, 1.0), at(0.0, 1.0)).alias("s"), geo.same_place(at(0.0, 1.0), at(0.0, 2.0)).alias("t")).first()
    assert tuple(r) == (True, True, False)
    with pytest.raises(ValueError, match="key"):
        decode.densify_track(df, "k", ["a"], 5, [])
    assert ev.evaluate(df, "a + 1", "x").count() == 5 and grid_5x3(spark).count() == 15
