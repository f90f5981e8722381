"""Findings of the fourth round."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tree import SCHEMA, cloud, near

from skyweave.operators import collocate as co
from skyweave.operators import tree
from skyweave.plans import catalogue as cat


def test_logarithms_of_ratios_on_a_tie(spark, tmp_path):
    """Ratios whose logarithm is so near a tie of the eighth digit that decimal text and the product with 10^8 round apart, and zero."""
    rows = [(0, 246.32, 50856), (1, 298.06, 8638), (2, 123.67, 53932), (3, 0.0, 3), (4, 2.0, 0), (5, None, 7), (6, 17.5, 3)]
    d = str(tmp_path)
    events = spark.createDataFrame(rows, "event_id bigint, value double, user_id bigint").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{d}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{d}/events.parquet/*.parquet'")
    want = dict(con.execute(cat.SQL["eval_log_ratio"]).fetchall())
    got = {r.event_id: r.out for r in cat.QUERIES["eval_log_ratio"](spark, d).collect()}
    assert got == want


def test_rounding_of_odd_values(spark):
    values = [0.0, -0.0, 1e-9, -5e-9, 0.5, 2.5e-8, 1e15 + 0.3, -1e300, 1e305, math.inf, -math.inf, math.nan, None, -5.330121885]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(cat.half_away(F.col("x"), 8).alias("x")).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 8)", [x]).fetchall()[0][0] for x in values]
    assert [str(x + 0 if x is not None else x) for x in got] == [str(x + 0 if x is not None else x) for x in want]


@pytest.mark.parametrize("run", [10, 2048])
@pytest.mark.parametrize("kernel", ["nn_t", "nn_p", "nn_a"])
def test_nearest_ahead_as_brute_force(spark, monkeypatch, kernel, run):
    """Many equal heights and pressures, crowded and lonely samples: short runs leave some samples to the trees, long ones few."""
    monkeypatch.setattr(tree, "RUN", run)
    monkeypatch.setattr(tree, "AHEAD", 40 if run == 10 else 4096)
    a, b = cloud(150, 31, 0.2, 5) + [(150, -80.0, 5.0, 1.0, 500.0, 3.0, 1.0)], cloud(900, 32, 0.9, 60)
    a += [(151, None, 0.0, 1.0, 500.0, 3.0, 1.0), (152, 1.0, 0.0, None, None, None, 1.0)]
    s, d = spark.createDataFrame(a, SCHEMA).drop("v").withColumnRenamed("id", "sample_id"), spark.createDataFrame(b, SCHEMA)
    a = [tuple(np.nan if x is None else x for x in r) for r in a]
    h = 6000.0 if run == 10 else 2500.0
    inside, k = near(a, b, h_sep=h), {"a": 3, "p": 4, "t": 5}[kernel[3]]
    x, y = (np.array([r[k] for r in rows], float) for rows in (a, b))
    far = np.maximum(x[:, None] / y, y / x[:, None]) if k == 4 else np.abs(x[:, None] - y)
    inside &= ~np.isnan(far)
    found = tree.nearest_ahead(*(tree._prepared(f, "h" + kernel[3], tree.Limits(h=h), 128, i, **m)[0] for f, i, m in ((s, "sample_id", {}), (d.where("v IS NOT NULL"), None, {"_v": F.col("v"), "_rid": F.col("id")}))), ["latitude", "longitude", tree.COORDINATES[kernel[3]][0]], "v", "sample_id", kernel[3], tree.Limits(h=h))
    done = found.groupBy("sample_id").agg(F.bool_and("done").alias("d")).where("d").count()
    assert 30 < done < 151 if run == 10 else done == 151, done
    got = co.box(s, d, ["v"], kernel, row_id="id", h_sep=h).collect()
    assert len(got) == 153
    for r in got:
        ok = [(far[r.sample_id, j], b[j][0], b[j][6]) for j in range(len(b)) if inside[r.sample_id, j] and b[j][6] is not None]
        assert r.v == (min(ok)[2] if ok else None), r
