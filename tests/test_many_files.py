"""Reads of many extracted files: as many jobs as for few."""

import pytest

from skyweave.sources import read
from skyweave.sources.extracted import coverage_time


def write(folder, columns, attributes):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for part, data in (("values", columns), ("attributes", dict(zip(("variable", "key", "value"), zip(*[(v, k, x) for v, a in attributes.items() for k, x in a.items()]))))):
        (folder / part).mkdir(parents=True)
        pq.write_table(pa.table({c: pa.array(list(x)) for c, x in data.items()}), folder / part / "part-0.parquet")
    return str(folder)


def jobs_of(spark, group, fn):
    sc = spark.sparkContext
    sc.setJobGroup(group, "")
    try:
        out = fn()
        return out, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


@pytest.fixture(scope="module")
def daily(tmp_path_factory):
    """200 grids of unlike times and titles, of which 20 are scaled in another way."""
    top = tmp_path_factory.mktemp("many files")  # a blank in the path
    out = []
    for i in range(200):
        scale = {"scale_factor": "0.5", "add_offset": "1"} if i % 10 == 0 else {}
        own = {"time_coverage_start": f"2008{1 + i // 28:02}{1 + i % 28:02}T000000Z", "time_coverage_end": f"2008{1 + i // 28:02}{1 + i % 28:02}T120000Z", "title": f"file {i}"}
        out.append(write(top / f"ESACCI-L3C_AEROSOL-{i}.nc", {"lat": [1.0, 2.0], "lon": [3.0, 3.0], "aod": [float(i), -9.0]}, {"": own, "aod": {"_FillValue": "-9", "history": f"made {i}", **scale}}))
    return out


def test_jobs_do_not_grow_with_files(spark, daily):
    few, jobs_few = jobs_of(spark, "few", lambda: read(spark, daily[:20], "aod").collect())
    many, jobs_many = jobs_of(spark, "many", lambda: read(spark, daily, "aod").collect())
    # Spark lists over 32 folders by a job: one for the attributes, one or two for the values.
    assert len(few) == 40 and len(many) == 400 and jobs_many <= jobs_few + 3
    got = {(round(r.time, 6), r.latitude): r.aod for r in many}
    for i in range(200):
        day = coverage_time(f"2008{1 + i // 28:02}{1 + i % 28:02}T060000Z")
        assert got[round(day, 6), 1.0] == (i * 0.5 + 1 if i % 10 == 0 else i) and got[round(day, 6), 2.0] is None


def test_stations_keep_their_own_places(spark, tmp_path):
    paths = [write(tmp_path / f"s{i}.nc", {"time": [float(i)], "co": [1.0 * i]}, {"": {"GASSP_Version": "1", "Station_Lat": f"{i}.5 S", "Station_Lon": f"{10 + i}", "Station_Altitude": "7m"}, "time": {"units": "days since 2000-01-01"}}) for i in range(3)]
    rows = sorted(read(spark, paths, "co").collect(), key=lambda r: r.co)
    assert [(r.latitude, r.longitude, r.altitude) for r in rows] == [(-0.5, 10.0, 7.0), (-1.5, 11.0, 7.0), (-2.5, 12.0, 7.0)]
