"""File-to-file jobs on folders written from the fixture views."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wxframe import jobs
from wxframe.functions.columns import add_hours
from wxframe.plans.registry import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scratch():
    return tempfile.mkdtemp(prefix="wxframe-jobs-", dir="/tmp")


def test_build_station_dataset(spark, scratch):
    from tests.test_files import _station_files
    root = os.path.join(scratch, "csv")
    _station_files(root)
    st = os.path.join(scratch, "stations.csv")
    with open(st, "w") as fh:
        fh.write("code,name,lat,lon,alt\nA0,S0,-30.0,120.0,10\nA1,S1,-31.0,121.0,\n")
    out = os.path.join(scratch, "obs")
    cube = jobs.build_station_dataset(spark, root, st, out, year=2024)
    back = spark.read.parquet(out)
    assert back.count() == cube.count() > 0
    assert {r.station for r in back.select("station").distinct().collect()} == {"S0", "S1"}
    assert back.groupBy("station", "time").count().where("count > 1").count() == 0


def test_clean_forecast_runs(spark, scratch):
    v = Views(spark, SF)
    base = os.path.join(scratch, "fc")
    parts = {"year": F.year("time"), "month": F.month("time"), "day": F.dayofmonth("time")}
    v.fc.withColumns(parts).withColumn("member", F.lit("single")) \
        .write.partitionBy("year", "month", "day", "member").parquet(base)
    v.fc_pl.withColumnRenamed("level", "isobaricInhPa").withColumns(parts).withColumn("member", F.lit("pressure")) \
        .write.mode("append").partitionBy("year", "month", "day", "member").parquet(base)
    out = os.path.join(scratch, "fc_clean")
    res = jobs.clean_forecast_runs(spark, base, out, missing={"t2m": 9999.0})
    back = spark.read.parquet(out)
    assert back.count() == res.count() > 0
    assert {"t2m", "t850", "u500", "v1000"} <= set(back.columns)
    assert back.where("t2m > 100").count() == 0          # Kelvin -> Celsius, sentinel nulled


def test_clean_and_refine_reanalysis(spark, scratch):
    v = Views(spark, SF)
    base = os.path.join(scratch, "era5")
    e = v.era5.withColumns({"year": F.year("valid_time"), "month": F.month("valid_time")})
    keys = ["valid_time", "latitude", "longitude", "year", "month"]
    e.select(*keys, "tp").withColumn("member", F.lit("accum")).write.partitionBy("year", "month", "member").parquet(base)
    e.select(*keys, "t2m", "u10", "v10", "tcc").withColumn("member", F.lit("instant")) \
        .write.mode("append").partitionBy("year", "month", "member").parquet(base)
    levels = F.explode(F.array(F.lit(500), F.lit(850), F.lit(1000))).alias("pressure_level")
    pl = (e.select(*keys, "t2m", levels)
          .select(*keys, "pressure_level", (F.col("t2m") / 3).alias("r")).withColumn("member", F.lit("pressure")))
    pl.write.mode("append").partitionBy("year", "month", "member").parquet(base)
    monthly = os.path.join(scratch, "era5_clean")
    res = jobs.clean_reanalysis(spark, base, monthly)
    assert {"t2m", "tp", "r500", "r850", "r1000"} <= set(res.columns)
    n_hours = spark.read.parquet(monthly).count()
    fine = os.path.join(scratch, "era5_15min")
    jobs.refine_reanalysis(spark, monthly, fine)
    out = spark.read.parquet(fine)
    assert out.count() >= 4 * n_hours
    assert out.where("r850 IS NOT NULL").count() > 0
