"""Statistics and catalog queries: completeness, resampled means, extents,
metadata, display variables, dataset synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round6
from ..operators import catalog as CT
from ..operators import select as S
from ..operators import series as SR
from ..operators import stats as ST
from ..sources.fixtures import table
from .q_frames import OBS_VARS, _wide_sql
from .q_levels import FC_KEYS, _clean_sql, forecast_clean
from .registry import Views, register
from .sqlfrag import r6


@register("completeness", """
SELECT station, count(*) FILTER (WHERE variable = 'airTemperature' AND value IS NOT NULL
                                 AND NOT isnan(value) AND NOT isinf(value)) AS n_valid
FROM v_obs GROUP BY station
""")
def completeness(spark, sf_dir):
    return ST.completeness(Views(spark, sf_dir).obs, "airTemperature")


def _resample_sql(unit: str, start: str, end_excl: str, last_bin: str) -> str:
    return f"""
WITH src AS (SELECT * FROM v_obs WHERE variable = 'airTemperature'
             AND time >= TIMESTAMP '{start}' AND time < TIMESTAMP '{end_excl}'),
b AS (SELECT station, date_trunc('{unit}', time) AS bin, avg(value) AS mean FROM src GROUP BY 1, 2),
g AS (SELECT s.station, unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{last_bin}', INTERVAL 1 {unit})) AS bin
      FROM (SELECT DISTINCT station FROM src) s)
SELECT g.station, g.bin AS time, {r6('b.mean')} AS mean FROM g LEFT JOIN b ON g.station = b.station AND g.bin = b.bin
"""


@register("daily_mean", _resample_sql("day", "2024-01-03 00:00:00", "2024-01-13 00:00:00", "2024-01-12 00:00:00"))
def daily_mean(spark, sf_dir):
    out = ST.resample_mean(Views(spark, sf_dir).obs, "airTemperature", "1 day", "2024-01-03", "2024-01-12")
    return out.withColumn("mean", round6("mean"))


@register("hourly_mean", _resample_sql("hour", "2024-01-05 00:00:00", "2024-01-07 00:00:00", "2024-01-06 23:00:00"))
def hourly_mean(spark, sf_dir):
    out = ST.resample_mean(Views(spark, sf_dir).obs, "airTemperature", "1 hour", "2024-01-05", "2024-01-06")
    return out.withColumn("mean", round6("mean"))


@register("extent", "SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM v_stations")
def extent(spark, sf_dir):
    return S.extent(Views(spark, sf_dir).stations)


@register("dataset_metadata", f"""
WITH w AS ({_wide_sql(OBS_VARS)}), c AS (SELECT w.*, s.lat, s.lon FROM w JOIN v_stations s ON w.station = s.station)
SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max,
       strftime(min(time), '%Y-%m-%dT%H:%M:%S') AS time_start, strftime(max(time), '%Y-%m-%dT%H:%M:%S') AS time_end,
       count(DISTINCT time) AS time_count, count(DISTINCT station) AS station_count FROM c
""")
def dataset_metadata(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ST.series_metadata(v.obs.where(F.col("variable").isin(OBS_VARS)), v.stations)


@register("ui_meta", """
SELECT station,
       (SELECT strftime(min(time), '%Y-%m-%d') FROM v_obs) AS date_min,
       (SELECT strftime(max(time), '%Y-%m-%d') FROM v_obs) AS date_max,
       (SELECT string_agg(variable, ',' ORDER BY variable) FROM (SELECT DISTINCT variable FROM v_obs)) AS variables,
       'stations' AS source
FROM (SELECT DISTINCT station FROM v_obs)
""")
def ui_meta(spark, sf_dir):
    return ST.ui_meta(Views(spark, sf_dir).obs)


@register("at_hour", """
SELECT o.* FROM v_obs o
JOIN (SELECT station, min(time) AS t FROM v_obs WHERE CAST(time AS DATE) = DATE '2024-01-07' AND hour(time) = 12
      GROUP BY station) m ON o.station = m.station AND o.time = m.t
""")
def at_hour(spark, sf_dir):
    return S.at_hour(Views(spark, sf_dir).obs, "2024-01-07", 12)


# --- display variables over the cleaned forecast (variables measured on the data) ---

_CLEAN_COLS = ["t2m", "msl", "u10", "v10", "tp"] + [f"{v}{lv}" for v in ("t", "u", "v") for lv in (250, 500, 850, 1000)]


def _present_sql() -> str:
    counts = ", ".join(f"count({c}) AS {c}" for c in _CLEAN_COLS)
    rows = " UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS pos, {c} AS n FROM cnt" for i, c in enumerate(_CLEAN_COLS))
    return f"cnt AS (SELECT {counts} FROM ({_clean_sql()})), present AS (SELECT name, pos FROM ({rows}) WHERE n > 0)"


_DISPLAY_SQL = f"""WITH {_present_sql()},
us AS (SELECT name AS u, pos, substr(name, 2) AS sfx FROM present WHERE starts_with(name, 'u')),
vs AS (SELECT name AS v, substr(name, 2) AS sfx FROM present WHERE starts_with(name, 'v')),
uj AS (SELECT us.*, vs.v FROM us LEFT JOIN vs ON us.sfx = vs.sfx),
parts AS (
  SELECT 'wind' || sfx AS display, 'wind' AS kind, u, v, 0 AS grp, pos FROM uj WHERE v IS NOT NULL
  UNION ALL SELECT u, 'scalar', NULL, NULL, 0, pos FROM uj WHERE v IS NULL
  UNION ALL SELECT name, 'scalar', NULL, NULL, 1, pos FROM present
    WHERE name NOT IN (SELECT u FROM uj) AND name NOT IN (SELECT v FROM uj WHERE v IS NOT NULL))
SELECT display, kind, u, v, CAST(row_number() OVER (ORDER BY grp, pos) - 1 AS BIGINT) AS ord FROM parts"""


def _display(v):
    clean = forecast_clean(v.fc, v.fc_pl)
    return CT.display_vars(CT.variables_present(clean, FC_KEYS))


@register("display_vars", _DISPLAY_SQL)
def display_vars(spark, sf_dir):
    return _display(Views(spark, sf_dir))


@register("default_var", f"""
WITH d AS ({_DISPLAY_SQL})
SELECT coalesce((SELECT display FROM d WHERE display IN ('t2m', 'airTemperature', 't', 'temperature')
                 ORDER BY list_position(['t2m', 'airTemperature', 't', 'temperature'], display) LIMIT 1),
                (SELECT display FROM d ORDER BY ord LIMIT 1)) AS default_var
""")
def default_var(spark, sf_dir):
    return CT.default_var(_display(Views(spark, sf_dir)))


@register("compatible_pairs", f"""
WITH {_present_sql()}
SELECT m.var_a, m.var_b FROM (VALUES ('t2m', 'airTemperature'), ('d2m', 'dewPoint')) m(var_a, var_b)
WHERE m.var_a IN (SELECT name FROM present) AND m.var_b IN (SELECT DISTINCT variable FROM v_obs)
""")
def compatible_pairs(spark, sf_dir):
    v = Views(spark, sf_dir)
    fc_vars = CT.variables_present(forecast_clean(v.fc, v.fc_pl), FC_KEYS)
    obs_vars = v.obs.select(F.col("variable").alias("name")).distinct()
    return CT.compatible_pairs(fc_vars, obs_vars)


_DIMS_SQL = """
SELECT variable, max(latitude IS NOT NULL) AS la, max(longitude IS NOT NULL) AS lo, max(t IS NOT NULL) OR max(step IS NOT NULL) AS ti
FROM (SELECT 'v' || l_linenumber AS variable, CASE WHEN l_linenumber <> 5 THEN l_partkey END AS latitude,
             CASE WHEN l_linenumber <> 6 THEN l_suppkey END AS longitude, CASE WHEN l_linenumber < 3 THEN l_shipdate END AS t,
             CASE WHEN l_linenumber IN (2, 3, 4) THEN l_quantity END AS step FROM lineitem) GROUP BY variable
"""


def _gridded(spark, sf_dir):
    """Long rows of seven variables: some lack an axis, some have a time, some a step, some neither."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("v"), n.cast("string")).alias("variable"), F.when(n != 5, F.col("l_partkey")).alias("latitude"),
        F.when(n != 6, F.col("l_suppkey")).alias("longitude"), F.when(n < 3, F.col("l_shipdate")).alias("time"),
        F.when(n.isin(2, 3, 4), F.col("l_quantity")).alias("step"))


@register("candidate_vars", f"SELECT variable FROM ({_DIMS_SQL}) WHERE la AND lo AND ti")
def candidate_vars(spark, sf_dir):
    return CT.candidate_vars(CT.variable_dims(_gridded(spark, sf_dir), ["time", "step", "latitude", "longitude"]))


@register("candidate_vars_untimed", f"SELECT variable FROM ({_DIMS_SQL}) WHERE la AND lo")
def candidate_vars_untimed(spark, sf_dir):
    # no variable has a time-like axis
    return CT.candidate_vars(CT.variable_dims(_gridded(spark, sf_dir), ["latitude", "longitude"]))


@register("candidate_vars_all", f"SELECT variable FROM ({_DIMS_SQL})")
def candidate_vars_all(spark, sf_dir):
    # no variable has both axes, so all are candidates
    return CT.candidate_vars(CT.variable_dims(_gridded(spark, sf_dir), ["time", "step", "latitude"]))


@register("shared_limits", """
WITH g AS (SELECT 't2m' AS var_a, 'airTemperature' AS var_b, min(t2m - 273.15e0) AS lo, max(t2m - 273.15e0) AS hi FROM v_era5
           UNION ALL SELECT 'd2m', 'dewPoint', min(t2m - 283.15e0), max(t2m - 283.15e0) FROM v_era5),
o AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM v_obs WHERE NOT isnan(value) AND NOT isinf(value) GROUP BY variable)
SELECT var_a, var_b, least(g.lo, o.lo) AS v_min, greatest(g.hi, o.hi) AS v_max FROM g JOIN o ON o.variable = g.var_b
""")
def shared_limits(spark, sf_dir):
    v = Views(spark, sf_dir)
    grid = v.era5.select((F.col("t2m") - 273.15).alias("t2m"), (F.col("t2m") - 283.15).alias("d2m"))
    return CT.shared_limits(v.obs, grid)


_SHARED_SQL = """
WITH a AS (SELECT CAST(min(CAST(time AS DATE)) AS TIMESTAMP) AS a0, CAST(max(CAST(time AS DATE)) AS TIMESTAMP) AS a1 FROM v_obs),
b AS (SELECT min(time) AS b0, max(time) AS b1 FROM v_fc)
SELECT CAST(CASE WHEN a1 - a0 <= b1 - b0 THEN a0 ELSE b0 END AS DATE) AS start_date,
       CAST(CASE WHEN a1 - a0 <= b1 - b0 THEN a1 ELSE b1 END AS DATE) AS end_date,
       CASE WHEN a1 - a0 <= b1 - b0 THEN 'stations' ELSE 'forecast' END AS source
FROM a, b
"""


def _shared(v):
    obs_days = v.obs.select(F.to_date("time").cast("timestamp_ntz").alias("day"))
    return CT.shared_range(obs_days, v.fc, "day", "time")


@register("shared_range", _SHARED_SQL)
def shared_range(spark, sf_dir):
    return _shared(Views(spark, sf_dir))


@register("sync_groups", f"""
WITH r AS ({_SHARED_SQL}),
g AS (SELECT CAST(strftime(valid_time, '%Y-%m-%d') AS DATE) AS d, min(i) AS si
      FROM (SELECT valid_time, row_number() OVER (ORDER BY valid_time) - 1 AS i
            FROM (SELECT DISTINCT time + to_microseconds(CAST(round(step * 3600e6) AS BIGINT)) AS valid_time FROM v_fc))
      GROUP BY 1),
gi AS (SELECT d, dense_rank() OVER (ORDER BY si) AS gi FROM g),
s AS (SELECT coalesce((SELECT min(gi) FROM gi, r WHERE d >= r.start_date), 1) AS s,
             coalesce((SELECT max(gi) FROM gi, r WHERE d <= r.end_date), (SELECT count(*) FROM gi)) AS e)
SELECT CAST(s - 1 AS BIGINT) AS start_group, CAST(greatest(s, e) - 1 AS BIGINT) AS end_group FROM s
""")
def sync_groups(spark, sf_dir):
    v = Views(spark, sf_dir)
    groups = ST.date_groups(SR.valid_time(v.fc).select("valid_time"))
    return CT.sync_groups(groups, _shared(v))


@register("station_display_vars", f"""
WITH p AS (SELECT variable AS name, min(pos) AS pos FROM (
             SELECT variable, CASE variable {' '.join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(OBS_VARS))} END AS pos
             FROM v_obs) GROUP BY 1),
b AS (SELECT count(DISTINCT name) = 2 AS both FROM p WHERE name IN ('wind_3m_speed', 'wind_3m_degN')),
u AS (SELECT name AS display, 1 AS grp, pos FROM p, b WHERE NOT (b.both AND name IN ('wind_3m_speed', 'wind_3m_degN'))
      UNION ALL SELECT 'wind_3m', 0, -1 FROM b WHERE b.both)
SELECT display, CAST(row_number() OVER (ORDER BY grp, pos) - 1 AS BIGINT) AS ord FROM u
""")
def station_display_vars(spark, sf_dir):
    # variables present in the observations, positioned in the station table's column order
    v = Views(spark, sf_dir)
    pos = F.create_map(*[x for i, name in enumerate(OBS_VARS) for x in (F.lit(name), F.lit(i))])
    present = v.obs.groupBy(F.col("variable").alias("name")).agg(F.min(pos[F.col("variable")]).alias("pos"))
    return CT.station_display_vars(present)
