"""Station-side queries: map frames, wind frames, series, reshapes, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import merge as M
from ..operators import reshape as R
from ..operators import select as S
from ..operators import series as SR
from .registry import Views, register
from .sqlfrag import nonfinite_null, pmod

OBS_VARS = ["airTemperature", "dewPoint", "rainfall", "solarExposure", "wind_3m_speed"]
FRAME_START, FRAME_END = "2024-01-03", "2024-01-10"

_FRAMES_SQL = f"""
SELECT o.time, o.station, s.lat, s.lon, {nonfinite_null('o.value')} AS value
FROM v_obs o JOIN v_stations s ON o.station = s.station
WHERE o.variable = 'airTemperature'
  AND o.time >= TIMESTAMP '{FRAME_START} 00:00:00' AND o.time < TIMESTAMP '{FRAME_END} 00:00:00' + INTERVAL 1 DAY
  AND s.lat BETWEEN -35.0e0 AND -13.0e0 AND s.lon BETWEEN 115.0e0 AND 129.0e0
"""


def _frames(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.map_frames(v.obs, v.stations, "airTemperature", FRAME_START, FRAME_END)


register("map_frames", _FRAMES_SQL)(_frames)


@register("value_range", f"SELECT min(value) AS vmin, max(value) AS vmax FROM ({_FRAMES_SQL}) f")
def value_range(spark, sf_dir):
    return R.value_range(_frames(spark, sf_dir))


@register("frames_by_time", f"""
SELECT time, string_agg(station, ',' ORDER BY station) AS stations, count(*) AS n_stations,
       count(*) - count(value) AS n_missing, min(value) AS vmin, max(value) AS vmax
FROM ({_FRAMES_SQL}) f GROUP BY time
""")
def frames_by_time(spark, sf_dir):
    g = R.frames_by_time(_frames(spark, sf_dir))
    return g.select("time", F.array_join(F.transform("frame", lambda x: x["station"]), ",").alias("stations"),
                    F.size("frame").cast("long").alias("n_stations"),
                    F.size(F.filter("frame", lambda x: x["value"].isNull())).cast("long").alias("n_missing"), "vmin", "vmax")


def _wide_sql(variables, extra_where: str = "") -> str:
    cols = ",\n  ".join(
        f"arg_min(value, event_id) FILTER (WHERE variable = '{v}') AS {v}" for v in variables)
    return f"SELECT station, time,\n  {cols}\nFROM v_obs {extra_where} GROUP BY station, time"


@register("wind_frames", f"""
WITH w AS ({_wide_sql(['wind_3m_speed', 'dewPoint'])})
SELECT w.time, w.station, s.lat, s.lon,
       coalesce(w.wind_3m_speed, 0.0e0) AS speed,
       coalesce({pmod('w.dewPoint + 180.0e0', '360.0e0')}, 0.0e0) AS angle
FROM w JOIN v_stations s ON w.station = s.station
WHERE s.lat BETWEEN -35.0e0 AND -13.0e0 AND s.lon BETWEEN 115.0e0 AND 129.0e0
""")
def wind_frames(spark, sf_dir):
    # The fixture has no wind-direction variable; dewPoint stands in for it.
    v = Views(spark, sf_dir)
    wide = R.to_wide(v.obs, ["station", "time"], ["wind_3m_speed", "dewPoint"], order_col="event_id")
    return R.wind_frames(wide, v.stations, speed="wind_3m_speed", direction="dewPoint")


@register("station_series", """
SELECT station, strftime(time, '%Y-%m-%dT%H:%M:%S') AS time, variable,
       CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value
FROM v_obs
WHERE variable IN ('airTemperature', 'dewPoint') AND station = 'S7'
  AND time >= TIMESTAMP '2024-01-02 00:00:00' AND time < TIMESTAMP '2024-01-21 00:00:00'
""")
def station_series(spark, sf_dir):
    v = Views(spark, sf_dir)
    return SR.series(v.obs, ["airTemperature", "dewPoint", "notAVariable"], station="S7",
                     start="2024-01-02", end="2024-01-20", present=OBS_VARS)


@register("to_long", " UNION ALL ".join(
    f"SELECT valid_time, latitude, longitude, '{c}' AS variable, {c} AS value FROM v_era5"
    for c in ["t2m", "u10", "v10", "tp", "tcc"]))
def to_long(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.to_long(v.era5, ["valid_time", "latitude", "longitude"], ["t2m", "u10", "v10", "tp", "tcc"])


@register("to_wide", _wide_sql(OBS_VARS))
def to_wide(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.to_wide(v.obs, ["station", "time"], OBS_VARS, order_col="event_id")


@register("build_obs", f"""
WITH w AS ({_wide_sql(OBS_VARS)})
SELECT w.*, s.lat, s.lon, s.code FROM w JOIN v_stations s ON w.station = s.station
""")
def build_obs(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.build_obs(v.obs, v.stations, OBS_VARS)


@register("unknown_stations", """
SELECT DISTINCT station FROM v_obs WHERE station NOT IN (
  SELECT station FROM v_stations WHERE lat BETWEEN -35.0e0 AND -13.0e0 AND lon BETWEEN 115.0e0 AND 129.0e0)
""")
def unknown_stations(spark, sf_dir):
    v = Views(spark, sf_dir)
    return R.unknown_stations(v.obs, S.within_box(v.stations, C.WA_STATION_BOX))     # a list that lacks some stations


def _dekad(t: str = "time"):
    return F.least(F.floor((F.dayofmonth(t) - 1) / 10), F.lit(2))


@register("union_months", "SELECT station, time, variable, value, event_id FROM v_obs")
def union_months(spark, sf_dir):
    # month files are stood in for by ten-day pieces of the observation table
    v = Views(spark, sf_dir)
    obs = v.obs
    pieces = [obs.where(_dekad() == i) for i in range(3)]
    return M.union_all(pieces, mode="position")


def _without(name: str) -> list[str]:
    return [v for v in OBS_VARS if v != name]


def _piece_sql(vs, where: str) -> str:
    sel = ", ".join(v if v in vs else f"NULL::DOUBLE AS {v}" for v in OBS_VARS)
    return f"SELECT station, time, {sel} FROM ({_wide_sql(vs, where)})"


@register("union_stations", " UNION ALL ".join([
    _piece_sql(_without("dewPoint"), "WHERE station < 'S5'"), _piece_sql(_without("airTemperature"), "WHERE station >= 'S5'")]))
def union_stations(spark, sf_dir):
    # two station groups, each lacking one column; the other columns are all there
    obs = Views(spark, sf_dir).obs
    first = F.col("station") < "S5"
    a = R.to_wide(obs.where(first), ["station", "time"], _without("dewPoint"), order_col="event_id")
    b = R.to_wide(obs.where(~first), ["station", "time"], _without("airTemperature"), order_col="event_id")
    return M.union_all([a, b], mode="name").select("station", "time", *OBS_VARS)


_YEAR_PIECES = [_without("dewPoint"), _without("rainfall"), _without("airTemperature")]


def _union_years_sql():
    return " UNION ALL ".join(_piece_sql(vs, f"WHERE least(floor((dayofmonth(time) - 1) / 10), 2) = {i}")
                              for i, vs in enumerate(_YEAR_PIECES))


@register("union_years", _union_years_sql())
def union_years(spark, sf_dir):
    v = Views(spark, sf_dir)
    obs = v.obs
    pieces = [R.to_wide(obs.where(_dekad() == i), ["station", "time"], vs, order_col="event_id")
              for i, vs in enumerate(_YEAR_PIECES)]
    return M.union_all(pieces, mode="name").select("station", "time", *OBS_VARS)
