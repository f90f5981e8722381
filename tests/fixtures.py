"""Small point sets and grids of known values."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweave.operators.grid import Axis, spine

DAY = 140_480.0  # 1984-08-17 or so; only differences matter


def pts(spark, lats, lons, missing=(), days=False):
    rows, v = [], 0
    for a in lats:
        for b in lons:
            v += 1
            rows.append((v, float(a), float(b), None if v in missing else float(v), DAY + v - 1))
    df = spark.createDataFrame(rows, "row_id int, latitude double, longitude double, v double, time double")
    return df if days else df.drop("time")


def pts_5x3(spark, **kw):
    return pts(spark, (-10, -5, 0, 5, 10), (-5, 0, 5), **kw)


def lidar(spark):
    p = [4, 16, 20, 30, 40, 50, 60, 70, 80, 90]
    rows = [(5 * i + j + 1, -10.0 + 5 * j, -5 + 2.5 * j, 10.0 * i, float(p[i]), DAY + j, float(5 * i + j + 1)) for i in range(10) for j in range(5)]
    return spark.createDataFrame(rows, "row_id int, latitude double, longitude double, altitude double, air_pressure double, time double, v double")


def samples(spark, rows, names=("latitude", "longitude")):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "sample_id int, " + ", ".join(f"{n} double" for n in names))


LAT, LON = Axis.of_points("latitude", [-10, -5, 0, 5, 10]), Axis.of_points("longitude", [-5, 0, 5])


def grid_5x3(spark, missing=()):
    n = F.col("cell") + 1
    return spine(spark, [LAT, LON]).withColumn("v", F.when(~n.isin(*missing) if missing else F.lit(True), n.cast("double")))


def values(df, order, column="v"):
    return [None if r[column] is None else round(r[column], 6) for r in df.orderBy(*([order] if isinstance(order, str) else order)).collect()]
