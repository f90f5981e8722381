"""Swaths made denser both ways, and files whose attributes name their coordinates."""

import numpy as np
import pytest
from test_extensions import DAY0, extract, rows_of  # noqa: F401

from skyweave.errors import FileFormatError, InvalidVariableError
from skyweave.functions import decode
from skyweave.sources import read
from skyweave.sources.products import find_product

GASSP, UNITS = ("", "GASSP_Version", "1.4"), ("t", "units", "days since 2000-01-01")


def dense(x, times=5):
    """By two passes of numpy over the whole field; nothing outside the outermost centres."""
    half, (n, m) = times // 2, x.shape
    at = lambda k: half + times * np.arange(k)
    wide = np.array([np.interp(np.arange(m * times), at(m), line, np.nan, np.nan) for line in x])
    return np.array([np.interp(np.arange(n * times), at(n), line, np.nan, np.nan) for line in wide.T]).T


@pytest.mark.parametrize("lines", [2, 3, 64])
def test_swath_as_numpy(spark, lines):
    x = np.random.default_rng(3).normal(size=(9, 6))
    df = spark.createDataFrame([("a", i, j, float(x[i, j])) for i in range(9) for j in range(6)] + [("b", 0, 0, 7.0)], "g string, i int, j int, x double")
    got = np.full((45, 30), 9e9)
    for r in decode.densify_swath(df, "i", "j", ["x"], 5, ["g"], lines).collect():
        if r.g == "a":
            got[r.i * 5 + r.sub_row, r.j * 5 + r.sub_column] = np.nan if r.x is None else r.x
        else:  # a single point is its own centre, and nothing beside it
            assert r.x == (7.0 if (r.sub_row, r.sub_column) == (2, 2) else None)
    np.testing.assert_allclose(got, dense(x), atol=1e-12)
    with pytest.raises(ValueError):
        decode.densify_swath(df, "i", "j", ["x"], 4, ["g"])


def test_hole_in_a_swath(spark):
    df = spark.createDataFrame([("a", i, j, float(10 * i + j)) for i in range(3) for j in range(3) if (i, j) != (1, 1)], "g string, i int, j int, x double")
    out = {(r.i, r.j, r.sub_row, r.sub_column): r.x for r in decode.densify_swath(df, "i", "j", ["x"], 3, ["g"]).collect()}
    assert len(out) == 8 * 9
    assert out[0, 0, 2, 1] == pytest.approx(10 / 3) and out[0, 1, 2, 1] is None and out[1, 0, 1, 2] is None and out[0, 0, 1, 2] == pytest.approx(1 / 3)


def test_modis_of_one_kilometre(spark, extract):  # noqa: F811
    rows = [(float(10 * j), float(i), 0.0, i, j, 5, [100 * (5 * i + a) + 5 * j + b for a in range(5) for b in range(5)]) for i in range(3) for j in range(2)]
    a = [("Fine", "dimensions", "Cell_Along_Swath_1km:mod06 Cell_Across_Swath_1km:mod06"), ("Fine", "scale_factor", 0.5), ("Fine", "_FillValue", 203), ("Fine", "units", "K"), ("Coarse", "dimensions", "Cell_Along_Swath_5km Cell_Across_Swath_5km")]
    p = extract("MOD06_L2.A2010.hdf", "Longitude double, Latitude double, Scan_Start_Time double, _line int, _pixel int, Coarse int, Fine array<int>", rows, a)
    assert rows_of(read(spark, p, "Coarse").select("latitude", "longitude", "Coarse"))[:2] == [(0.0, 0.0, 5.0), (0.0, 10.0, 5.0)] and read(spark, p, "Coarse").count() == 6
    df = read(spark, p, "Fine")
    assert df.columns == ["latitude", "longitude", "time", "Fine"] and df.schema["Fine"].metadata["units"] == "K"
    got = {(round(r.latitude, 6), round(r.longitude, 6)): r.Fine for r in df.collect()}
    want = {(round((y - 2) / 5, 6), round((x - 2) * 2.0, 6)): None if 100 * y + x == 203 else 0.5 * (100 * y + x) for y in range(2, 13) for x in range(2, 8)}
    assert got == want
    q = extract("MOD06_L2.B.hdf", "Longitude double, Latitude double, Scan_Start_Time double, Fine array<int>", [(0.0, 0.0, 0.0, [1])], a)
    with pytest.raises(FileFormatError):
        read(spark, q, "Fine")


def test_flight_ship_station_and_best_names(spark, extract):  # noqa: F811
    names = [("", "Time_Coordinate", "t"), ("", "Latitude_Coordinate", "y"), ("", "Longitude_Coordinate", "x"), UNITS, GASSP]
    schema, row = "x double, y double, z double, t double, PRE double, LATC double, bc double", [(1.0, 2.0, 3.0, 0.5, 900.0, 77.0, 5.0)]
    flight = extract("f.nc", schema, row, [*names, ("", "Vertical_Coordinate", "z")])
    assert rows_of(read(spark, flight, "bc").select("longitude", "latitude", "altitude", "air_pressure", "time", "bc")) == [(1.0, 2.0, 3.0, 900.0, DAY0(2000, 1, 1, 12), 5.0)]
    ship = extract("s.nc", schema, row, names)
    assert rows_of(read(spark, ship, "bc").select("latitude", "altitude")) == [(2.0, 0.0)]
    station = extract("p.nc", schema, row, [names[0], UNITS, GASSP, ("", "station_lat", "45 degrees north"), ("", "Station_Lon", "-7.5"), ("", "Station_Altitude", "80 m asl")])
    assert rows_of(read(spark, station, ["bc", "y"]).select("latitude", "longitude", "altitude", "y")) == [(45.0, -7.5, 80.0, 2.0)]
    best = extract("r.nc", schema, row, [("", "Conventions", "NCAR-RAF/nimbus"), ("", "Coordinates", "x LATC z t"), UNITS, ("", "Station_Lat", "1")])
    assert find_product(spark, best).name == "NCAR_NetCDF_RAF" and rows_of(read(spark, best, "bc").select("latitude", "altitude")) == [(77.0, 3.0)]
    # Files of all kinds are read together, each by its own attributes.
    both = read(spark, [flight, ship, station, best], "bc", product="NCAR_NetCDF_RAF")
    assert sorted(r.latitude for r in both.collect()) == [2.0, 2.0, 45.0, 77.0]


def test_naming_attributes_that_fail(spark, extract):  # noqa: F811
    schema, row = "x double, y double, z double, t double", [(1.0, 2.0, 3.0, 0.5)]
    time = ("", "Time_Coordinate", "t")
    for i, a in enumerate(([time], [time, ("", "Latitude_Coordinate", "y")], [time, ("", "Latitude_Coordinate", "q"), ("", "Longitude_Coordinate", "x")], [("", "Coordinates", "x y t")], [("", "Coordinates", "x y z q")], [time, ("", "Station_Lat", "north"), ("", "Station_Lon", "1")])):
        with pytest.raises(InvalidVariableError):
            read(spark, extract(f"bad{i}.nc", schema, row, [GASSP, UNITS, *a]), "z")


def test_time_stamps_of_each_file(spark, extract):  # noqa: F811
    a = [GASSP, ("", "Time_Coordinate", "t"), ("", "Latitude_Coordinate", "y"), ("", "Longitude_Coordinate", "x"), ("t", "units", "hours from the file's reference")]
    paths = [extract(f"h{i}.nc", "x double, y double, t double, v double", [(1.0, 2.0, 6.0, float(i))], [*a, ("", "Time_Stamp_Info", f"2001-02-0{i} 00:00:00")]) for i in (1, 2)]
    assert sorted((r.v, round(r.time, 6)) for r in read(spark, paths, "v").collect()) == [(i, DAY0(2001, 2, i, 6)) for i in (1, 2)]


def test_a_dimension_beside_time(spark, extract):  # noqa: F811
    a = [GASSP, ("", "Coordinates", "x y z t"), UNITS, ("size", "dimensions", "t bins"), ("size", "units", "cm-3"), ("size", "_FillValue", -1), ("diameter", "dimensions", "bins"), ("deep", "dimensions", "t bins m")]
    schema, row = "x double, y double, z double, t double, v double, size array<double>, diameter array<double>", [(1.0, 2.0, 3.0, float(i), 10.0 * i, [1.0 + i, -1.0, 3.0 + i], [0.1, 0.2, 0.4]) for i in (0, 1)]
    p = extract("a.nc", schema, row, a)
    assert read(spark, p, "v").columns[-1] == "v" and read(spark, p, "v").count() == 2
    df = read(spark, p, ["size", "v"])
    assert rows_of(df.select("diameter", "size", "v")) == [(0.1, 1.0, 0.0), (0.1, 2.0, 10.0), (0.2, None, 0.0), (0.2, None, 10.0), (0.4, 3.0, 0.0), (0.4, 4.0, 10.0)]
    assert df.schema["size"].metadata == {"units": "cm-3"}
    q = extract("b.nc", schema + ", deep array<array<double>>", [(*row[0], [[1.0]])], a)
    with pytest.raises(InvalidVariableError):
        read(spark, q, "v")
