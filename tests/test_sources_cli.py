import pytest

from skyweave import cli
from skyweave.errors import ClassNotFoundError, FileFormatError, InvalidCommandLineOptionError, InvalidVariableError
from skyweave.operators.grid import Axis
from skyweave.sources import Product, read, register, variables
from skyweave.sources import products as pr
from skyweave.sources import sinks

AERONET = """Level 2.0. Quality Assured Data
Some words
Location=Ascension_Island,long=-14.415,lat=-7.976,elev=30.000,Nmeas=7,PI=Someone
Another line
Date(dd-mm-yy),Time(hh:mm:ss),Julian_Day,AOT_1640,AOT_500
16:10:2008,12:00:00,290.5,N/A,0.1
17:10:2008,06:00:00,291.25,-999.,0.2
"""


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "a.txt").write_text("1, 2, 3, 154863.5, 10\n4, 5, 6, 2024-01-02, 20\n7,,9,154864,30\n")
    (tmp_path / "site.lev20").write_text(AERONET)
    (tmp_path / "p.csv").write_text("latitude,longitude,rain,wind\n1,2,3,4\n5,6,7,8\n")
    return tmp_path


def test_hyperpoints(spark, files):
    rows = read(spark, f"{files}/a.txt", "value").orderBy("latitude").collect()
    assert [(r.latitude, r.time, r.value) for r in rows] == [(1, 154863.5, 10), (4, 154864.0, 20)]  # no longitude: no point


def test_aeronet(spark, files):
    rows = read(spark, f"{files}/site.lev20", ["AOT_*"], fills=(-999.0,)).orderBy("time").collect()
    assert [(r.longitude, r.latitude, r.altitude, r.AOT_1640, r.AOT_500) for r in rows] == [(-14.415, -7.976, 30, None, 0.1), (-14.415, -7.976, 30, None, 0.2)]
    assert rows[1].time - rows[0].time == 0.75
    (files / "bad.lev20").write_text("nothing\n")
    with pytest.raises(FileFormatError):
        read(spark, f"{files}/bad.lev20", "x")


def test_variables_aliases_and_errors(spark, files):
    assert variables(spark, f"{files}/p.csv") == ["rain", "wind"]
    assert read(spark, [f"{files}/p.csv"] * 2, ["w*", "rain"], aliases=["a", "b"]).columns == ["latitude", "longitude", "a", "b"]
    with pytest.raises(InvalidVariableError):
        read(spark, f"{files}/p.csv", "snow")
    with pytest.raises(InvalidVariableError):
        pr.read_one(spark, f"{files}/p.csv", "*")
    with pytest.raises(ClassNotFoundError):
        read(spark, "x.unknown", "v")


def test_user_product(spark, files):
    @register
    class Mine(Product):
        name, signatures, priority = "mine", (r"p\.csv",), 500

        def scan(self, spark, paths):
            return pr.CsvPoints().scan(spark, paths).withColumnRenamed("rain", "water")

    try:
        assert variables(spark, f"{files}/p.csv") == ["water", "wind"]
    finally:
        del pr.PRODUCTS["mine"]


def test_sinks_keep_metadata(spark, files):
    df = sinks.annotate(read(spark, f"{files}/p.csv", "rain"), {"rain": {"units": "mm"}}, history="read")
    df = sinks.annotate(df, {"rain": {}}, history="again")
    sinks.save(df, f"{files}/o.parquet")
    assert spark.read.parquet(f"{files}/o.parquet").schema["rain"].metadata == {"units": "mm", "history": "read\nagain"}
    assert "units" not in sinks.remove_attribute(df, "rain", "units").schema["rain"].metadata
    with pytest.raises(Exception):
        sinks.save(df, f"{files}/o.parquet")
    axes = [Axis.regular("latitude", 0, 10, 5)]
    sinks.save_grid(df, axes, f"{files}/g")
    assert sinks.read_axes(spark, f"{files}/g")[0].lo == (0, 5)
    sinks.save_points(df, f"{files}/cells")
    assert spark.read.parquet(f"{files}/cells").count() == 2


def test_grammar():
    assert cli.parse_group("a,b=c:x.txt,y.txt:kernel=mean") == (["a", "b"], ["a", "c"], ["x.txt", "y.txt"], {"kernel": "mean"})
    assert cli.parse_group(r"a\:b:x.txt")[0] == ["a:b"]
    assert cli.parse_limits("x=[1,2],t=[2024-01]")["x"] == (1, 2) and cli.parse_limits("y=[,5]") == {"y": (None, 5)}
    assert cli.parse_grid("x=[0,10,5],t=[2024-01-01,2024-01-02,P1D]")["t"][2] == 1
    assert cli.parse_method("box[h_sep=50,t_sep=P1D]") == ("box", {"h_sep": "50", "t_sep": "P1D"}) and cli.separations({"h_sep": "500m", "t_sep": "PT12H"}) == {"h_sep": 0.5, "t_sep": 0.5}
    for bad in (lambda: cli.parse_group("x"), lambda: cli.parse_limits("x=[20,10]"), lambda: cli.parse_limits("x=[0,400]"), lambda: cli.parse_grid("x=[0,10]"), lambda: cli.split_outside("a[b", ",")):
        with pytest.raises(InvalidCommandLineOptionError):
            bad()


def test_commands(spark, files, capsys):
    go = lambda *a: cli.main(list(a), spark)
    assert go("version") == 0 and go("info", f"{files}/p.csv") == 0
    assert go("sub", f"rain:{files}/p.csv", "x=[0,3]", "-o", f"{files}/s.parquet") == 0 and spark.read.parquet(f"{files}/s.parquet").count() == 1
    assert go("agg", f"rain:{files}/p.csv:kernel=mean", "x=[0,8,4]", "-o", f"{files}/a.parquet") == 0
    assert sorted(r.rain for r in spark.read.parquet(f"{files}/a.parquet").collect()) == [3, 7]
    assert go("col", f"rain:{files}/p.csv", f"{files}/a.txt:box[h_sep=600km],kernel=max", "-o", f"{files}/c.parquet") == 0
    assert go("eval", f"rain,wind=w:{files}/p.csv", "rain * w", "mm", "-o", f"x:{files}/e.parquet") == 0
    assert sorted(r.x for r in spark.read.parquet(f"{files}/e.parquet").collect()) == [12, 56]
    assert go("stats", f"rain,wind:{files}/p.csv") == 0 and "num_points: 2" in capsys.readouterr().out
    assert go("sub", f"rain:{files}/p.csv", "x=[50,60]", "-o", f"{files}/n.parquet") == 1
