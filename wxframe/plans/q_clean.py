"""Cleaning queries: de-duplication, zone shift, units, sentinels, station lists, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import merge as M
from ..operators import select as S
from ..operators import timegrid as TG
from ..operators import units as U
from .registry import Views, register
from .sqlfrag import nonfinite_null


@register("dedupe_time", """
SELECT station, variable, date_trunc('hour', time) AS time,
       arg_min(value, event_id) AS value, min(event_id) AS event_id
FROM v_obs GROUP BY 1, 2, 3
""")
def dedupe_time(spark, sf_dir):
    # hourly labels make many duplicates per (station, variable, time); first in file order wins
    v = Views(spark, sf_dir)
    obs = v.obs.withColumn("time", F.date_trunc("hour", "time").cast("timestamp_ntz"))
    return TG.dedupe_time(obs, ["station", "variable"], "time", "event_id")


@register("shift_time", """
SELECT station, time AS time_raw, time + INTERVAL 16 HOUR AS time,
       timezone('Australia/Perth', time AT TIME ZONE 'UTC') + INTERVAL 16 HOUR AS time_local
FROM v_obs
""")
def shift_time(spark, sf_dir):
    v = Views(spark, sf_dir)
    df = v.obs.select("station", F.col("time").alias("time_raw"), F.col("time"))
    df = TG.shift_time(df, "time_raw", output="wall", out_col="time_local")
    return TG.shift_time(df, "time", output="utc")


ERA5_VARS = ["t2m", "d2m", "u10", "v10", "tp", "tcc"]
ERA5_KEYS = ["valid_time", "latitude", "longitude"]


@register("select_convert_units_era5", """
SELECT valid_time, latitude, longitude, t2m - 273.15e0 AS t2m, u10 * 3.6e0 AS u10, v10 * 3.6e0 AS v10,
       tp * 1000.0e0 AS tp, tcc
FROM v_era5
""")
def select_convert_units_era5(spark, sf_dir):
    v = Views(spark, sf_dir)
    df = S.select_variables(v.era5, ERA5_KEYS, ERA5_VARS)
    out, _units = U.convert_units(df, C.REANALYSIS_UNIT_GROUPS, match="exact")
    return out


@register("null_missing", """
SELECT time, step, latitude, longitude,
       CASE WHEN abs(t2m - 9999.0e0) <= 1e-08 + 1e-05 * 9999.0e0 THEN NULL ELSE t2m END AS t2m,
       msl, u10, v10, tp
FROM v_fc
""")
def null_missing(spark, sf_dir):
    v = Views(spark, sf_dir)
    return U.null_missing(v.fc, {"t2m": 9999.0, "msl": 9999.0})


@register("count_missing", """
SELECT 't2m' AS variable, count(*) FILTER (WHERE abs(t2m - 9999.0e0) <= 1e-08 + 1e-05 * 9999.0e0) AS n_missing FROM v_fc
UNION ALL
SELECT 'msl', count(*) FILTER (WHERE abs(msl - 9999.0e0) <= 1e-08 + 1e-05 * 9999.0e0) FROM v_fc
""")
def count_missing(spark, sf_dir):
    v = Views(spark, sf_dir)
    return U.count_missing(v.fc, {"t2m": 9999.0, "msl": 9999.0})


@register("null_nonfinite", f"""
SELECT time, step, latitude, longitude,
       {nonfinite_null("CASE WHEN t2m = 9999.0e0 THEN 'NaN'::DOUBLE ELSE t2m END")} AS t2m,
       {nonfinite_null("CASE WHEN tp = 0.0e0 THEN 'Infinity'::DOUBLE ELSE tp END")} AS tp
FROM v_fc
""")
def null_nonfinite(spark, sf_dir):
    # the fixture is all finite; plant NaN on the sentinel and +Inf on zero precipitation
    v = Views(spark, sf_dir)
    df = v.fc.select("time", "step", "latitude", "longitude",
                     F.when(F.col("t2m") == 9999.0, F.lit(float("nan"))).otherwise(F.col("t2m")).alias("t2m"),
                     F.when(F.col("tp") == 0.0, F.lit(float("inf"))).otherwise(F.col("tp")).alias("tp"))
    return S.null_nonfinite_cols(df, ["t2m", "tp"])


@register("drop_coords", "SELECT * FROM v_fc")
def drop_coords(spark, sf_dir):
    v = Views(spark, sf_dir)
    df = v.fc.withColumns({"expver": F.lit("0001"), "number": F.lit(0)})
    return S.drop_coords(df, C.REFINE_DROP_COORDS + C.FORECAST_DROP_COORDS)


@register("known_stations", "SELECT * FROM v_obs WHERE station IN (SELECT station FROM v_stations)")
def known_stations(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.keep_known(v.obs, v.stations)


@register("missing_stations", "SELECT * FROM v_stations s WHERE NOT EXISTS (SELECT 1 FROM v_obs o WHERE o.station = s.station)")
def missing_stations(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.missing_stations(v.stations, v.obs)


EXCLUDED = C.HULL_EXCLUDE_STATIONS + ["S1", "S2", "S3", "S10", "S100"]


@register("exclude_stations", "SELECT * FROM v_stations WHERE station NOT IN ("
          + ", ".join(f"'{n}'" for n in EXCLUDED) + ")")
def exclude_stations(spark, sf_dir):
    v = Views(spark, sf_dir)
    return S.exclude_stations(v.stations, EXCLUDED)


@register("wa_station_filter", """
SELECT * FROM v_stations WHERE lat BETWEEN -35.0e0 AND -13.0e0 AND lon BETWEEN 115.0e0 AND 129.0e0
""")
def wa_station_filter(spark, sf_dir):
    v = Views(spark, sf_dir)
    return S.within_box(v.stations, C.WA_STATION_BOX)


def _grid_filter_sql(box):
    la0, la1, lo0, lo1 = (f"{float(x)!r}e0" for x in box)
    return f"""
WITH f AS (SELECT coalesce(bool_or(latitude BETWEEN {la0} AND {la1}), false) AS al,
                  coalesce(bool_or(longitude BETWEEN {lo0} AND {lo1}), false) AS ao FROM v_fc)
SELECT v.* FROM v_fc v, f
WHERE NOT (f.al AND f.ao) OR (v.latitude BETWEEN {la0} AND {la1} AND v.longitude BETWEEN {lo0} AND {lo1})
"""


GRID_BOX_PART = (-26.4, -10.0, 113.3, 135.0)
GRID_BOX_NO_LAT = (-20.0, -10.0, 110.0, 135.0)


@register("wa_grid_filter", _grid_filter_sql(GRID_BOX_PART))
def wa_grid_filter(spark, sf_dir):
    v = Views(spark, sf_dir)
    return S.within_box_or_all(v.fc, GRID_BOX_PART)


@register("wa_grid_filter_empty_axis", _grid_filter_sql(GRID_BOX_NO_LAT))
def wa_grid_filter_empty_axis(spark, sf_dir):
    # no latitude of the grid lies in the box: the mask is not applied at all
    v = Views(spark, sf_dir)
    return S.within_box_or_all(v.fc, GRID_BOX_NO_LAT)


# stations moved into the forecast grid's area, some of them beyond its edges
_AREA_STATIONS = """SELECT station, -25.0e0 + (lat + 36.0e0) / -13.0e0 AS lat, 112.5e0 + (lon - 110.0e0) / 15.0e0 AS lon FROM v_stations"""
_EXTENT_SQL = f"""
SELECT s.* FROM ({_AREA_STATIONS}) s,
  (SELECT min(latitude) AS a, max(latitude) AS b, min(longitude) AS c, max(longitude) AS d FROM v_fc) e
WHERE s.lat BETWEEN e.a AND e.b AND s.lon BETWEEN e.c AND e.d
"""


def _area_stations(v):
    return v.stations.select("station", (F.lit(-25.0) + (F.col("lat") + 36.0) / -13.0).alias("lat"),
                             (F.lit(112.5) + (F.col("lon") - 110.0) / 15.0).alias("lon"))


@register("extent_filter", _EXTENT_SQL)
def extent_filter(spark, sf_dir):
    v = Views(spark, sf_dir)
    return S.filter_by_extent(_area_stations(v), v.fc)


@register("filter_counts", f"""
SELECT (SELECT count(*) FROM v_stations) AS n_before, (SELECT count(*) FROM ({_EXTENT_SQL})) AS n_after
""")
def filter_counts(spark, sf_dir):
    v = Views(spark, sf_dir)
    st = _area_stations(v)
    before = st.agg(F.count(F.lit(1))).scalar()
    after = S.filter_by_extent(st, v.fc).agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(before.alias("n_before"), after.alias("n_after"))
