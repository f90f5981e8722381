"""Gridded products as grids: their axes, merged files, and what is done with them."""

import datetime as dt
import itertools

import pytest

from skyweave.dataset import Dataset, read_data_list
from skyweave.errors import InconsistentDimensionsError
from skyweave.functions.time import to_days
from skyweave.sources import grids

LATS, LONS = [-60.0, -20.0, 20.0, 60.0], [0.0, 90.0, 180.0, 270.0]


def write(spark, path, rows, schema, attributes):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/values")
    spark.createDataFrame([(v, k, x) for v, a in attributes.items() for k, x in a.items()], "variable string, key string, value string").write.parquet(f"{path}/attributes")
    return str(path)


def cells(lats=LATS, lons=LONS):
    return [(a, b, 10.0 * i + j) for (i, a), (j, b) in itertools.product(enumerate(lats), enumerate(lons))]


def netcdf(spark, path, day, rows=None):
    rows = [(a, b, float(day), v + 100 * day) for a, b, v in rows or cells()]
    return write(spark, path, rows, "lat double, lon double, time double, rain double", {"time": {"units": "days since 2000-01-01"}, "rain": {"units": "mm", "_FillValue": "113"}})


def modis3(spark, path, day):
    rows = [(a, b, v) for a, b, v in cells()]
    return write(spark, path, rows, "YDim double, XDim double, Cloud double", {"": {"RANGEBEGINNINGDATE": f"2008-01-0{day}", "RANGEBEGINNINGTIME": "00:00:00.0", "RANGEENDINGDATE": f"2008-01-0{day}", "RANGEENDINGTIME": "12:00:00.0"}})


def cci3(spark, path, day):
    return write(spark, path, cells(), "lat double, lon double, aod double", {"": {"time_coverage_start": f"2008010{day}T000000Z", "time_coverage_end": f"2008010{day}T235959Z"}})


@pytest.mark.parametrize("name,make,variable,product", [("x.nc", netcdf, "rain", "NetCDF_Gridded"), ("MOD08_D3.1.hdf", modis3, "Cloud", None), ("ESACCI-L3C_AEROSOL-1.nc", cci3, "aod", None), ("ESACCI-L3C_CLOUD-1.nc", cci3, "aod", None), ("abcdef.pd2000.nc", netcdf, "rain", None)])
def test_products_are_grids(spark, tmp_path, name, make, variable, product):
    d = read_data_list(spark, make(spark, tmp_path / name, 1), variable, product)
    assert d.gridded and [a.name for a in d.axes] == ["latitude", "longitude"] and d.axes[1].cyclic
    assert d.axes[0].points == tuple(LATS) and d.axes[0].lo[0] == -80 and d.axes[1].hi == (45, 135, 225, 315)
    base = 100.0 if make is netcdf else 0.0
    value = lambda i, j: None if make is netcdf and i == 1 and j == 3 else base + 10 * i + j
    got = {r.cell: r[variable] for r in d.df.collect()}
    assert got == {4 * i + j: value(i, j) for i in range(4) for j in range(4)}
    by_lat = {r.latitude_i: r[variable] for r in d.collapsed("longitude", how="max").df.collect()}
    assert by_lat == {i: base + 10 * i + (2 if make is netcdf and i == 1 else 3) for i in range(4)}
    samples = Dataset(spark.createDataFrame([(0, 0.0, 45.0, 7.0), (1, 40.0, 315.0, 7.0), (2, -20.0, 270.0, 7.0)], "sample_id bigint, latitude double, longitude double, time double"), ())
    lin = {r.sample_id: r[variable] for r in samples.sampled_from(d, "lin").df.collect()}
    assert lin[0] == pytest.approx(base + 15.5) and lin[1] == pytest.approx(base + 26.5)  # between 270 and 0 again
    assert (lin[2] is None) == (make is netcdf)
    assert {r.sample_id: r[variable] for r in samples.sampled_from(d, "nn").df.collect()}[1] == pytest.approx(base + 23)
    rain = Dataset(spark.createDataFrame([(-50.0, 10.0, 1.0), (-70.0, 350.0, 3.0), (65.0, 100.0, 5.0)], "latitude double, longitude double, snow double"), ("snow",))
    binned = {r.cell: r.snow for r in rain.collocated_onto(d, "bin", "mean").df.where("snow IS NOT NULL").collect()}
    assert binned == {0: 2.0, 13: 5.0}


def test_files_are_merged_along_time(spark, tmp_path):
    paths = [netcdf(spark, tmp_path / f"{k}.nc", k) for k in (3, 1, 2)]
    d = read_data_list(spark, paths, "rain", "NetCDF_Gridded")
    assert [a.name for a in d.axes] == ["latitude", "longitude", "time"]
    assert d.axes[2].points == tuple(to_days(dt.datetime(2000, 1, 1)) + k for k in (1, 2, 3))
    assert {(r.time_i, r.rain) for r in d.df.where("latitude_i = 0 AND longitude_i = 2").collect()} == {(k - 1, 100.0 * k + 2) for k in (1, 2, 3)}
    days = {(r.latitude_i, r.longitude_i): r.rain for r in d.collapsed("time", how="mean").df.collect()}
    assert days[2, 1] == 221.0 and len(days) == 16
    with pytest.raises(InconsistentDimensionsError):
        read_data_list(spark, [*paths, netcdf(spark, tmp_path / "again.nc", 2)], "rain", "NetCDF_Gridded").df.count()


def test_files_continue_an_axis(spark, tmp_path):
    south, north = netcdf(spark, tmp_path / "s.nc", 1, cells(LATS[:2])), netcdf(spark, tmp_path / "n.nc", 1, [(a, b, v + 20) for a, b, v in cells(LATS[2:])])
    d = read_data_list(spark, [north, south], "rain", "NetCDF_Gridded", aliases=["r"])
    assert [len(a) for a in d.axes] == [4, 4] and d.variables == ("r",)
    assert {r.cell: r.r for r in d.df.where("cell <> 7").collect()} == {4 * i + j: 100.0 + 10 * i + j for i in range(4) for j in range(4) if (i, j) != (1, 3)}


def test_bounds_and_auxiliary_heights(spark, tmp_path):
    """Stored bounds with gaps; heights over orography stay beside the variable, and pass a collapse of longitudes by their own mean."""
    rows = [(a, b, [a - 5, a + 5], 100.0 * k + 0.5 * abs(a) + b, k, float(k + a)) for a in LATS for b in LONS for k in (1.0, 2.0)]
    p = write(spark, tmp_path / "h.nc", rows, "lat double, lon double, lat_bnds array<double>, altitude double, air_pressure double, t1 double", {"lat": {"bounds": "lat_bnds"}})
    d = read_data_list(spark, p, "t1", "NetCDF_Gridded")
    assert [a.name for a in d.axes] == ["latitude", "longitude", "air_pressure"]
    assert d.axes[0].lo == tuple(a - 5 for a in LATS) and d.axes[0].hi == tuple(a + 5 for a in LATS)
    assert "altitude" in d.df.columns and d.df.where("altitude <> 100 * air_pressure + 0.5 * abs(latitude) + longitude").isEmpty()


def test_axes():
    assert grids.regular_step([0, 0.1, 0.2, 0.30000000000000004]) == pytest.approx(0.1) and grids.regular_step([0, 1, 3]) is None and grids.regular_step([4]) is None
    assert grids.find_axis("longitude", [-180 + 0.25 * i for i in range(1440)]).cyclic and not grids.find_axis("longitude", [0, 10, 20]).cyclic
    assert grids.find_axis("time", [1, 2, 5], [(0, 1.5), (1.5, 3), (4, 6)]).lo == (0, 1.5, 4)


def test_curved_points_are_no_grid(spark, tmp_path):
    """Every cell with a latitude and a longitude of its own: points."""
    rows = [(a + 0.01 * j, b + 0.01 * i, v) for (i, a), (j, b), v in ((x, y, 1.0) for x in enumerate(LATS) for y in enumerate(LONS))]
    p = write(spark, tmp_path / "c.nc", rows, "lat double, lon double, v double", {})
    d = read_data_list(spark, p, "v", "NetCDF_Gridded")
    assert not d.gridded and d.df.count() == 16


def test_unlike_coordinates(spark):
    a, b = spark.createDataFrame([(1.0, 2.0, 3.0)], "latitude double, longitude double, v double"), spark.createDataFrame([(1.0, 3.0)], "latitude double, v double")
    with pytest.raises(InconsistentDimensionsError):
        grids.merge([a, b], ["v"])
    with pytest.raises(InconsistentDimensionsError):
        grids.grid_of(a, ["v"])


def test_space_is_looked_at_before_a_write(spark, tmp_path, monkeypatch):
    from skyweave.sources import sinks

    d = read_data_list(spark, netcdf(spark, tmp_path / "w.nc", 1), "rain", "NetCDF_Gridded")
    assert sinks.warn_of_space(d.df, f"{tmp_path}/new/folder/out") is None
    monkeypatch.setattr(sinks, "warn_of_space", lambda df, path: "about 9 TB to write, 1 GB left")
    with pytest.warns(ResourceWarning, match="9 TB"):
        d.save_data(f"{tmp_path}/out")
    assert read_data_list(spark, f"{tmp_path}/out", "rain").gridded
