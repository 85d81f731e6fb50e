"""End-to-end batch jobs: the operators wired from files to files.

* ``build_station_dataset``: station CSV folders -> zone shift -> keep-first
  de-duplication -> known stations -> (station, time) cube with coordinates
  -> Parquet partitioned by year.
* ``clean_forecast_runs``: forecast run members -> sentinel nulling ->
  level flattening -> alignment -> units -> variable selection -> one
  folder per run.
* ``clean_reanalysis``: reanalysis month members -> nearest-level flattening
  -> alignment -> units -> selection -> monthly folders.
* ``refine_reanalysis``: monthly hourly fields -> 15-minute grid (PCHIP,
  linear, uniform spread, label fill) with the next month's first hour as
  buffer -> monthly folders.

Every job is one Spark plan per output; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions.columns import step_hours_from_ns
from .operators import levels as L
from .operators import merge as M
from .operators import reshape as R
from .operators import select as S
from .operators import timegrid as TG
from .operators import units as U
from .sources import files as FS

FC_KEYS = ["time", "step", "latitude", "longitude"]
ERA_KEYS = ["valid_time", "latitude", "longitude"]


def build_station_dataset(spark: SparkSession, csv_root: str, stations_csv: str, out: str | None = None,
                          year=None, shift_hours: float = C.DEFAULT_SHIFT_HOURS,
                          variables=C.STATION_VARIABLES) -> DataFrame:
    raw = FS.read_station_csv(spark, csv_root, year)
    shifted = TG.shift_time(raw, "time", hours=shift_hours)
    clean = TG.dedupe_time(shifted, ["station"], "time", "_ingest").drop("_ingest", "month")
    stations = FS.read_stations(spark, stations_csv)
    known = M.keep_known(clean, stations)
    cube = R.attach_coords(known.select("station", "time", *[v for v in variables if v in known.columns]), stations)
    if out:
        FS.write_obs(cube, out)
    return cube


def _decoded_steps(df: DataFrame) -> DataFrame:
    """Lead time in hours; integer steps are nanoseconds, as the decoder writes them."""
    whole = df.schema["step"].dataType.simpleString() == "bigint"
    return df.withColumn("step", step_hours_from_ns("step")) if whole else df


def clean_forecast_runs(spark: SparkSession, base: str, out: str | None = None,
                        missing: dict | None = None, levels=C.FORECAST_LEVELS) -> DataFrame:
    members = FS.read_forecast(spark, base)
    single, pl = (_decoded_steps(members[m].drop("year", "month", "day")) for m in ("single", "pressure"))
    if "isobaricInhPa" in pl.columns:
        pl = pl.withColumnRenamed("isobaricInhPa", "level")
    if missing:
        single = U.null_missing(single, missing)
        pl = U.null_missing(pl, missing)
    pl_vars = [c for c in pl.columns if c not in FC_KEYS + ["level"]]
    flat = L.flatten_levels(pl, FC_KEYS, pl_vars, levels)
    merged = M.align_merge([single, flat], FC_KEYS)
    conv, units = U.convert_units(merged, C.FORECAST_UNIT_GROUPS, match="levels")
    conv = S.drop_coords(conv, C.FORECAST_DROP_COORDS)
    result = S.select_variables(conv, FC_KEYS, C.FORECAST_VARS)
    if out:
        FS.write_runs(result, out, "time")
        FS.write_units(spark, {c: u for c, u in units.items() if c in result.columns}, out)
    return result


def clean_reanalysis(spark: SparkSession, base: str, out: str | None = None, strict: bool = True,
                     targets=C.NEAREST_TARGET_LEVELS) -> DataFrame:
    members = FS.read_reanalysis(spark, base, strict=strict)
    accum = members["accum"].drop("year", "month")
    instant = members["instant"].drop("year", "month")
    pl = members["pressure"].drop("year", "month")
    if "pressure_level" in pl.columns:
        pl = pl.withColumnRenamed("pressure_level", "level")
    pl_vars = [c for c in pl.columns if c not in ERA_KEYS + ["level"]]
    flat = L.flatten_levels_nearest(pl, ERA_KEYS, pl_vars, targets)
    merged = M.align_merge([accum, instant, flat], ERA_KEYS)
    conv, units = U.convert_units(merged, C.REANALYSIS_UNIT_GROUPS, match="exact")
    result = S.select_variables(conv, ERA_KEYS, C.REANALYSIS_VARS)
    if out:
        FS.write_monthly(result, out, "valid_time")
        FS.write_units(spark, {c: u for c, u in units.items() if c in result.columns}, out)
    return result


def refine_reanalysis(spark: SparkSession, monthly_path: str, out: str | None = None,
                      skip_existing: bool = False) -> DataFrame:
    df = S.drop_coords(spark.read.parquet(monthly_path), C.REFINE_DROP_COORDS)
    df = df.withColumn("period", F.col("year") * 100 + F.col("month")).drop("year", "month")
    present = set(df.columns)
    pchip = [v for v in C.PCHIP_VARS if v in present]
    linear = [v for v in C.LINEAR_VARS if v in present]
    spread = [v for v in C.PRECIP_VARS if v in present]
    named = set(pchip + linear + spread + ERA_KEYS + ["period"])
    ffill = [v for v in df.columns if v not in named]
    fine = TG.interpolate_grid(df, ["latitude", "longitude"], "valid_time", "period",
                               pchip=pchip, linear=linear, spread=spread, ffill=ffill)
    fine = fine.drop("period")
    if out:
        FS.write_monthly(fine, out, "valid_time", skip_existing=skip_existing)
    return fine
