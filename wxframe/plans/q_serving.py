"""Serving queries on the forecast grid: fields, GeoJSON, wind, thinning, limits, axes, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round6, wind_angle, wind_speed
from ..operators import display as D
from ..operators import reshape as R
from ..operators import select as S
from ..operators import series as SR
from ..operators import stats as ST
from ..operators import units as U
from .registry import Views, register
from .sqlfrag import hypot, r6
from .sqlfrag import wind_angle as sql_wind_angle

FC_NULLED = """(SELECT time, step, latitude, longitude,
       CASE WHEN abs(t2m - 9999.0e0) <= 1e-08 + 1e-05 * 9999.0e0 THEN NULL ELSE t2m END AS t2m,
       msl, u10, v10, tp FROM v_fc)"""


def _fc(v):
    return U.null_missing(v.fc, {"t2m": 9999.0})


def _axis_pick_sql(axis: str, idx: int) -> str:
    return (f"(SELECT {axis} FROM (SELECT {axis}, row_number() OVER (ORDER BY {axis}) - 1 AS i "
            f"FROM (SELECT DISTINCT {axis} FROM v_fc)) "
            f"WHERE i = (SELECT greatest(0, least({idx}, count(DISTINCT {axis}) - 1)) FROM v_fc))")


def _slice_sql(ti: int, si: int) -> str:
    return f"(SELECT * FROM {FC_NULLED} WHERE time = {_axis_pick_sql('time', ti)} AND step = {_axis_pick_sql('step', si)})"


@register("field_slice", f"SELECT latitude AS lat, longitude AS lon, t2m AS value FROM {_slice_sql(3, 2)}")
def field_slice(spark, sf_dir):
    return R.field(_fc(Views(spark, sf_dir)), "t2m", 3, 2)


@register("field_slice_clamped", f"SELECT latitude AS lat, longitude AS lon, t2m AS value FROM {_slice_sql(999, -4)}")
def field_slice_clamped(spark, sf_dir):
    # out-of-range indices clamp to the last run time and the first step
    return R.field(_fc(Views(spark, sf_dir)), "t2m", 999, -4)


@register("field_geojson", f"""
SELECT latitude AS lat, longitude AS lon,
       to_json({{'type': 'Feature', 'geometry': {{'type': 'Point', 'coordinates': [longitude, latitude]}},
                'properties': {{'value': t2m}}}})::VARCHAR AS feature
FROM {_slice_sql(3, 2)} WHERE t2m IS NOT NULL
""")
def field_geojson(spark, sf_dir):
    return R.field_geojson(R.field(_fc(Views(spark, sf_dir)), "t2m", 3, 2))


@register("wind_geojson", f"""
SELECT lat, lon,
       to_json({{'type': 'Feature', 'geometry': {{'type': 'Point', 'coordinates': [lon, lat]}},
                'properties': {{'value': speed, 'angle_degN': angle, 'speed': speed}}}})::VARCHAR AS feature
FROM (SELECT latitude AS lat, longitude AS lon, {r6(hypot('u10', 'v10'))} AS speed,
             {r6(sql_wind_angle('u10', 'v10'))} AS angle FROM {_slice_sql(3, 2)})
""")
def wind_geojson(spark, sf_dir):
    wf = R.wind_field(_fc(Views(spark, sf_dir)), "u10", "v10", 3, 2)
    wf = wf.withColumns({"speed": round6("speed"), "angle": round6("angle")})
    return R.field_geojson(wf, kind="wind")


@register("wind_uv", f"""
SELECT time, step, latitude, longitude, {r6(hypot('u10', 'v10'))} AS speed,
       {r6(sql_wind_angle('u10', 'v10'))} AS angle FROM v_fc
""")
def wind_uv(spark, sf_dir):
    v = Views(spark, sf_dir)
    return v.fc.select("time", "step", "latitude", "longitude",
                       round6(wind_speed("u10", "v10")).alias("speed"),
                       round6(wind_angle("u10", "v10")).alias("angle"))


@register("thin_stride", f"""
WITH f AS (SELECT latitude, longitude, t2m FROM {_slice_sql(3, 2)}),
la AS (SELECT latitude, dense_rank() OVER (ORDER BY latitude DESC) - 1 AS r FROM (SELECT DISTINCT latitude FROM f)),
lo AS (SELECT longitude, dense_rank() OVER (ORDER BY longitude) - 1 AS r FROM (SELECT DISTINCT longitude FROM f))
SELECT f.* FROM f WHERE latitude IN (SELECT latitude FROM la WHERE r % 2 = 0)
  AND longitude IN (SELECT longitude FROM lo WHERE r % 2 = 0)
""")
def thin_stride(spark, sf_dir):
    f = S.slice_field(_fc(Views(spark, sf_dir)), 3, 2).select("latitude", "longitude", "t2m")
    return D.thin(f, 2)


_FINE_GRID_SQL = """(SELECT -26.0e0 - 0.1e0 * CAST(l_partkey % 70 AS DOUBLE) AS latitude,
        113.0e0 + 0.1e0 * CAST(l_suppkey % 90 AS DOUBLE) AS longitude, max(l_quantity) AS value
 FROM lineitem GROUP BY 1, 2)"""


def _fine_grid(spark, sf_dir):
    from ..sources.fixtures import table
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy((F.lit(-26.0) - 0.1 * (F.col("l_partkey") % 70).cast("double")).alias("latitude"),
                       (F.lit(113.0) + 0.1 * (F.col("l_suppkey") % 90).cast("double")).alias("longitude"))
            .agg(F.max("l_quantity").alias("value")))


@register("thin_auto", f"""
WITH g AS {_FINE_GRID_SQL},
la AS (SELECT latitude, dense_rank() OVER (ORDER BY latitude DESC) - 1 AS r FROM (SELECT DISTINCT latitude FROM g)),
lo AS (SELECT longitude, dense_rank() OVER (ORDER BY longitude) - 1 AS r FROM (SELECT DISTINCT longitude FROM g)),
s AS (SELECT greatest(1, CAST(floor(count(*) / 30) AS BIGINT)) AS s FROM la)
SELECT g.* FROM g WHERE latitude IN (SELECT latitude FROM la, s WHERE r % s.s = 0)
  AND longitude IN (SELECT longitude FROM lo, s WHERE r % s.s = 0)
""")
def thin_auto(spark, sf_dir):
    # a 70 x 90 cell grid built from lineitem: stride = 70 // 30 = 2
    return D.thin(_fine_grid(spark, sf_dir), "auto")


_FRAMES = """(SELECT time, time_idx FROM (SELECT time, row_number() OVER (ORDER BY time) - 1 AS time_idx
   FROM (SELECT DISTINCT time FROM v_fc))
 WHERE time_idx BETWEEN (SELECT greatest(0, least(5, count(DISTINCT time) - 1)) FROM v_fc)
                    AND (SELECT greatest(greatest(0, least(5, count(DISTINCT time) - 1)),
                                         greatest(0, least(12, count(DISTINCT time) - 1))) FROM v_fc))"""


@register("frame_range", f"SELECT f.*, r.time_idx FROM v_fc f JOIN {_FRAMES} r ON f.time = r.time")
def frame_range(spark, sf_dir):
    return S.frame_range(Views(spark, sf_dir).fc, 5, 12)


@register("scale_limits", f"""
SELECT min(t2m) AS vmin, max(t2m) AS vmax FROM {FC_NULLED} f JOIN {_FRAMES} r ON f.time = r.time
""")
def scale_limits(spark, sf_dir):
    return ST.scale_limits(_fc(Views(spark, sf_dir)), "t2m", 5, 12)


@register("wind_limits", f"""
SELECT {r6('min(' + hypot('u10', 'v10') + ')')} AS vmin, {r6('max(' + hypot('u10', 'v10') + ')')} AS vmax
FROM v_fc f JOIN {_FRAMES} r ON f.time = r.time
""")
def wind_limits(spark, sf_dir):
    out = ST.wind_limits(Views(spark, sf_dir).fc, "u10", "v10", 5, 12)
    return out.select(round6("vmin").alias("vmin"), round6("vmax").alias("vmax"))


DISPLAY_VARS = ["wind10", "wind500", "tcc", "t2m", "msl", "tp"]


@register("display_limits", f"""
WITH a AS (SELECT max({hypot('u10', 'v10')}) AS w, min(t2m) AS t0, max(t2m) AS t1,
                  min(msl) AS m0, max(msl) AS m1, min(tp) AS p0, max(tp) AS p1 FROM {FC_NULLED})
SELECT 'wind10' AS variable, 0.0e0 AS vmin, {r6('w')} AS vmax FROM a
UNION ALL SELECT 'wind500', 0.0e0, 200.0e0
UNION ALL SELECT 'tcc', 0.0e0, 1.0e0
UNION ALL SELECT 't2m', t0, CASE WHEN t0 = t1 THEN t1 + 1.0e0 ELSE t1 END FROM a
UNION ALL SELECT 'msl', m0, CASE WHEN m0 = m1 THEN m1 + 1.0e0 ELSE m1 END FROM a
UNION ALL SELECT 'tp', p0, CASE WHEN p0 = p1 THEN p1 + 1.0e0 ELSE p1 END FROM a
""")
def display_limits(spark, sf_dir):
    out = ST.display_limits(_fc(Views(spark, sf_dir)), DISPLAY_VARS)
    return out.withColumn("vmax", F.when(F.col("variable") == "wind10", round6("vmax")).otherwise(F.col("vmax")))


@register("all_limits", "SELECT variable, min(value) AS vmin, max(value) AS vmax FROM v_obs GROUP BY variable")
def all_limits(spark, sf_dir):
    return ST.all_limits(Views(spark, sf_dir).obs)


@register("valid_time", """
SELECT time, step, latitude, longitude,
       time + to_microseconds(CAST(round(step * 3600e6) AS BIGINT)) AS valid_time,
       strftime(time + to_hours(CAST(trunc(step) AS BIGINT)), '%Y-%m-%d %H:%M') || ' (T=' || strftime(time, '%H:%M')
         || ' +' || CAST(CAST(trunc(step) AS BIGINT) AS VARCHAR) || 'h)' AS label,
       lower(strftime(time + to_microseconds(CAST(round(step * 3600e6) AS BIGINT)), '%d-%m-%Y %I:%M %p')) AS label_12h
FROM v_fc
""")
def valid_time(spark, sf_dir):
    v = Views(spark, sf_dir)
    return SR.valid_time(v.fc.select("time", "step", "latitude", "longitude"))


@register("normalize", f"""
WITH l AS (SELECT min(t2m) AS lo, max(t2m) AS hi FROM {FC_NULLED}),
n AS (SELECT f.time, f.step, f.latitude, f.longitude, f.t2m,
             CASE WHEN f.t2m IS NULL THEN NULL
                  ELSE greatest(0.0e0, least(1.0e0, (f.t2m - l.lo) / CASE WHEN l.hi - l.lo = 0 THEN 1.0e0 ELSE l.hi - l.lo END)) END AS p
      FROM {FC_NULLED} f, l)
SELECT time, step, latitude, longitude, t2m, {r6('p')} AS p, {r6('round(p * 12) / 12.0e0')} AS level,
       {r6('0.5e0 + 1.5e0 * p')} AS arrow_size FROM n
""")
def normalize(spark, sf_dir):
    fc = _fc(Views(spark, sf_dir)).select("time", "step", "latitude", "longitude", "t2m")
    lo = fc.agg(F.min("t2m")).scalar()
    hi = fc.agg(F.max("t2m")).scalar()
    out = D.normalize(fc, "t2m", lo, hi)
    return out.withColumns({c: round6(c) for c in ("p", "level", "arrow_size")})


@register("contour_levels", f"""
WITH l AS (SELECT min(t2m) AS lo, max(t2m) AS hi FROM {FC_NULLED})
SELECT CAST(i AS BIGINT) AS i, {r6('CASE WHEN i = 20 THEN hi ELSE lo + (hi - lo) / 20.0e0 * i END')} AS level
FROM l, range(21) t(i)
""")
def contour_levels(spark, sf_dir):
    lim = _fc(Views(spark, sf_dir)).agg(F.min("t2m").alias("vmin"), F.max("t2m").alias("vmax"))
    return D.contour_levels(lim).withColumn("level", round6("level"))


@register("axes", """
SELECT 'time' AS axis, CAST(row_number() OVER (ORDER BY time) - 1 AS BIGINT) AS idx,
       strftime(time, '%Y-%m-%d %H:%M') AS label, NULL::BIGINT AS value FROM (SELECT DISTINCT time FROM v_fc)
UNION ALL
SELECT 'step', CAST(row_number() OVER (ORDER BY step) - 1 AS BIGINT), CAST(CAST(step AS BIGINT) AS VARCHAR),
       CAST(step AS BIGINT) FROM (SELECT DISTINCT step FROM v_fc)
""")
def axes(spark, sf_dir):
    return ST.axes(Views(spark, sf_dir).fc)


_VT_SQL = "(SELECT DISTINCT time + to_microseconds(CAST(round(step * 3600e6) AS BIGINT)) AS valid_time FROM v_fc)"


@register("date_groups", f"""
SELECT strftime(valid_time, '%Y-%m-%d') AS label, CAST(min(i) AS BIGINT) AS start_idx, CAST(max(i) AS BIGINT) AS end_idx
FROM (SELECT valid_time, row_number() OVER (ORDER BY valid_time) - 1 AS i FROM {_VT_SQL}) GROUP BY 1
""")
def date_groups(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ST.date_groups(SR.valid_time(v.fc).select("valid_time"))


@register("step_hours", """
SELECT time, step AS step_raw, CAST(round(step * 3600e9) AS BIGINT) / 3600e9 AS step FROM v_fc
""")
def step_hours(spark, sf_dir):
    # lead times arrive as nanoseconds in decoded files; decode them back to hours
    from ..functions.columns import step_hours_from_ns
    fc = Views(spark, sf_dir).fc.select("time", F.col("step").alias("step_raw"),
                                        F.round(F.col("step") * 3600e9).cast("long").alias("step_ns"))
    return fc.select("time", "step_raw", step_hours_from_ns("step_ns").alias("step"))
