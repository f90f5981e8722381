import pytest
from fixtures import LAT, LON, grid_5x3, pts_5x3, samples, values

from skyweave.dataset import Dataset, get_variables, read_data
from skyweave.errors import InconsistentDimensionsError, InvalidDataTypeError, InvalidVariableError


def test_verbs_chain(spark, tmp_path):
    p = Dataset(pts_5x3(spark), ("v",))
    out = p.subset(y=(-10, 0)).aggregate("mean", y=(-10, 2, 6), x=(-6, 6, 12))
    assert values(out.df, "cell") == [3.5, 8] and out.gridded and "aggregate" in out.history
    assert values(out.collapsed("longitude", how="max").df, "latitude_i") == [3.5, 8]
    with pytest.raises(InconsistentDimensionsError):
        out.collapsed("time")
    with pytest.raises(InvalidDataTypeError):
        p.collapsed("latitude")
    with pytest.raises(InvalidDataTypeError):
        out.aggregate("mean", y=(0, 1, 1))
    out.save_data(f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/cells").count() == 2
    assert p.evaluate("v * 2", "w").select("w").as_data_frame().w.sum() == 240
    with pytest.raises(InvalidVariableError):
        p.select("z")


def test_sampling_by_kind(spark):
    p, g = Dataset(pts_5x3(spark), ("v",)), Dataset(grid_5x3(spark), ("v",), (LAT, LON))
    s = Dataset(samples(spark, [(1, 1), (4, 4)]), ())
    assert values(s.sampled_from(g).df, "sample_id") == [8.8, 11.2]
    assert values(s.sampled_from(p, kernel="nn_h", h_sep=900).df, "sample_id") == [8, 12]
    assert values(p.collocated_onto(g, kernel="mean").df, "cell") == [float(i) for i in range(1, 16)]
    assert values(g.sampled_from(g, "nn").df, "cell") == [float(i) for i in range(1, 16)]
    assert values(g.sampled_from(p, "box", "mean", h_sep=10).df, "cell") == [float(i) for i in range(1, 16)]
    masked = Dataset(grid_5x3(spark, missing=(3,)), ("v",), (LAT, LON))
    assert values(masked.sampled_from(p, kernel="mean", missing_data_for_missing_sample=True).df, "cell")[2] is None
    with pytest.raises(InvalidDataTypeError):
        s.sampled_from(g, kernel="mean")


def test_reading(spark, tmp_path):
    (tmp_path / "p.csv").write_text("latitude,longitude,rain,wind\n1,2,3,4\n")
    assert get_variables(spark, f"{tmp_path}/p.csv") == ["rain", "wind"]
    d = read_data(spark, f"{tmp_path}/p.csv", "rain")
    assert d.coords == ["latitude", "longitude"] and d.set_longitude_range(-180).info().first().present == 1
    with pytest.raises(InvalidVariableError):
        read_data(spark, f"{tmp_path}/p.csv", "*")
