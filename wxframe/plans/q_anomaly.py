"""Anomaly queries on the dense 15-minute station series."""

from __future__ import annotations


from ..operators import anomaly as A
from ..operators import select as S
from .registry import Views, register

_FRAME_SQL = """
WITH s AS (SELECT station, time, airTemperature, solarExposure FROM v_series15),
w AS (SELECT *,
        CASE WHEN count(airTemperature) OVER w5 = 5 THEN median(airTemperature) OVER w5 END AS med,
        lag(airTemperature) OVER w AS prv, lead(airTemperature) OVER w AS nxt,
        count(solarExposure) OVER ws AS scnt, median(solarExposure) OVER ws AS smed,
        stddev_samp(solarExposure) OVER ws AS ssd,
        row_number() OVER w - 1 AS pos
      FROM s
      WINDOW w AS (PARTITION BY station ORDER BY time),
             w5 AS (PARTITION BY station ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
             ws AS (PARTITION BY station ORDER BY time ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
d AS (SELECT *, abs(airTemperature - med) AS dev, (airTemperature - prv) / 0.25e0 AS slope_in,
             (nxt - airTemperature) / 0.25e0 AS slope_out,
             CASE WHEN hour(time) + minute(time) / 60.0e0 >= 6 AND hour(time) + minute(time) / 60.0e0 < 12 THEN 1
                  WHEN hour(time) + minute(time) / 60.0e0 >= 16 AND hour(time) + minute(time) / 60.0e0 < 21 THEN -1
                  ELSE 0 END AS zone
      FROM w),
d2 AS (SELECT *, abs(slope_out - slope_in) AS change FROM d),
t AS (SELECT station, avg(dev) + 3.0e0 * stddev_samp(dev) AS mthr, avg(change) + 4.0e0 * stddev_pop(change) AS sthr, count(dev) AS devs
      FROM d2 GROUP BY station),
f AS (SELECT d2.*, t.devs, coalesce(dev > mthr, false) AS median_flag, coalesce(change > sthr, false) AS slope_flag,
             coalesce(zone <> 0 AND prv IS NOT NULL AND abs(slope_in) >= 0.2e0 AND sign(slope_in) <> zone, false) AS zone_flag,
             coalesce(scnt >= 3 AND ssd IS NOT NULL AND ssd <> 0 AND abs(solarExposure - smed) > 2.5e0 * ssd, false) AS explained
      FROM d2 JOIN t ON d2.station = t.station),
g AS (SELECT *, devs > 0 AND (median_flag OR slope_flag OR zone_flag) AS anomaly FROM f)
"""


def _frame(spark, sf_dir, **kw):
    return A.anomaly_frame(Views(spark, sf_dir).series15, **kw)


_OUT = "station, time, airTemperature"


@register("median_anomalies", _FRAME_SQL + f"SELECT {_OUT} FROM g WHERE median_flag")
def median_anomalies(spark, sf_dir):
    return _frame(spark, sf_dir).where("median_flag").select("station", "time", "airTemperature")


@register("slope_anomalies", _FRAME_SQL + f"SELECT {_OUT} FROM g WHERE slope_flag")
def slope_anomalies(spark, sf_dir):
    return _frame(spark, sf_dir).where("slope_flag").select("station", "time", "airTemperature")


@register("zone_anomalies", _FRAME_SQL + f"SELECT {_OUT}, zone FROM g WHERE zone_flag")
def zone_anomalies(spark, sf_dir):
    return _frame(spark, sf_dir).where("zone_flag").select("station", "time", "airTemperature", "zone")


_FLAGS = "median_flag, slope_flag, zone_flag"


@register("detect_anomalies", _FRAME_SQL + f"SELECT {_OUT}, {_FLAGS} FROM g WHERE anomaly")
def detect_anomalies(spark, sf_dir):
    return A.detect_anomalies(_frame(spark, sf_dir)).select(
        "station", "time", "airTemperature", "median_flag", "slope_flag", "zone_flag")


@register("classify_solar", _FRAME_SQL + f"SELECT {_OUT}, solarExposure, explained FROM g WHERE anomaly")
def classify_solar(spark, sf_dir):
    return A.classify_solar(_frame(spark, sf_dir)).select(
        "station", "time", "airTemperature", "solarExposure", "explained")


@register("explained_anomalies", _FRAME_SQL + f"SELECT {_OUT}, solarExposure FROM g WHERE anomaly AND explained")
def explained_anomalies(spark, sf_dir):
    return A.classify_solar(_frame(spark, sf_dir), mode="explained").select(
        "station", "time", "airTemperature", "solarExposure")


@register("median_anomalies_compat", _FRAME_SQL + f"""
, nn AS (SELECT station, dev, mthr, row_number() OVER (PARTITION BY station ORDER BY time) - 1 AS npos
         FROM f JOIN t USING (station) WHERE dev IS NOT NULL)
SELECT g.station, g.time, g.airTemperature FROM g JOIN nn ON g.station = nn.station AND g.pos = nn.npos
WHERE nn.dev > nn.mthr
""")
def median_anomalies_compat(spark, sf_dir):
    # flag placed at the deviation's index among non-null deviations (the original positional shift)
    return _frame(spark, sf_dir, compat_positions=True).where("median_flag").select(
        "station", "time", "airTemperature")


@register("day_of", _FRAME_SQL + """
SELECT v.* FROM v_series15 v
WHERE EXISTS (SELECT 1 FROM g WHERE g.anomaly AND g.explained AND g.station = v.station
              AND CAST(g.time AS DATE) = CAST(v.time AS DATE))
""")
def day_of(spark, sf_dir):
    v = Views(spark, sf_dir)
    marks = A.classify_solar(A.anomaly_frame(v.series15), mode="explained").select("station", "time")
    return S.day_of(v.series15, marks)


@register("temp_zone", """
SELECT station, time, CASE WHEN hour(time) + minute(time) / 60.0e0 >= 6 AND hour(time) + minute(time) / 60.0e0 < 12 THEN 1
                           WHEN hour(time) + minute(time) / 60.0e0 >= 16 AND hour(time) + minute(time) / 60.0e0 < 21 THEN -1
                           ELSE 0 END AS zone
FROM v_series15
""")
def temp_zone(spark, sf_dir):
    from ..functions.columns import temp_zone as zone
    return Views(spark, sf_dir).series15.select("station", "time", zone("time").alias("zone"))
