"""DuckDB definitions of the fixture views, used only by the SQL twins.

``with_views(sql)`` prefixes a query with the CTEs it references, so each
oracle string runs on the bare test tables.
"""

from __future__ import annotations

import re

VIEW_SQL = {
    "v_stations": """
SELECT 'S' || CAST(c_custkey AS VARCHAR(20)) AS station, c_name AS code,
       -36.0e0 + CAST((c_custkey * 37) % 260 AS DOUBLE) / 10.0e0 AS lat,
       110.0e0 + CAST((c_custkey * 53) % 250 AS DOUBLE) / 10.0e0 AS lon,
       CAST(c_custkey % 500 AS INT) AS alt
FROM customer""",
    "v_obs": """
SELECT 'S' || CAST(user_id AS VARCHAR(20)) AS station, ts AS time,
       CASE event_type WHEN 'click' THEN 'airTemperature' WHEN 'view' THEN 'dewPoint'
            WHEN 'purchase' THEN 'rainfall' WHEN 'signup' THEN 'solarExposure' ELSE 'wind_3m_speed' END AS variable,
       value, event_id
FROM events""",
    "v_series15": """
SELECT 'S' || CAST(t.g AS VARCHAR(20)) AS station,
       TIMESTAMP '2024-01-01 00:00:00' + (INTERVAL '15' MINUTE) * (t.n - 1) AS time,
       t.value AS airTemperature, CASE WHEN s.n % 17 = 0 THEN NULL ELSE s.value END AS solarExposure
FROM (SELECT user_id % 5 AS g, event_type, value,
             row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) AS n
      FROM events WHERE event_type = 'click') t
LEFT JOIN (SELECT user_id % 5 AS g, event_type, value,
             row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) AS n
      FROM events WHERE event_type = 'signup') s ON t.g = s.g AND t.n = s.n""",
    "v_era5": """
SELECT valid_time, -26.0e0 - 0.25e0 * c AS latitude, 113.0e0 + 0.25e0 * c AS longitude,
       273.15e0 + v / 10.0e0 AS t2m, v / 10.0e0 - 5.0e0 AS u10, w / 10.0e0 - 5.0e0 AS v10,
       w / 100000.0e0 AS tp, least(v / 200.0e0, 1.0e0) AS tcc
FROM (SELECT user_id % 5 AS c, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS valid_time,
             max(value) AS v, min(value) AS w FROM events GROUP BY 1, 2) h""",
    "v_fc": """
SELECT TIMESTAMP '2024-01-01 00:00:00' + (INTERVAL '1' DAY) * (l_orderkey % 60) AS time,
       CAST(l_linenumber * 3 AS DOUBLE) AS step,
       -26.0e0 - 0.25e0 * CAST(l_partkey % 4 AS DOUBLE) AS latitude, 113.0e0 + 0.25e0 * CAST(l_suppkey % 5 AS DOUBLE) AS longitude,
       CASE WHEN max(l_quantity) = 50 THEN 9999.0e0 ELSE 273.15e0 + max(l_quantity) END AS t2m,
       100000.0e0 + min(l_extendedprice) / 10.0e0 AS msl,
       max(l_quantity) - 25.0e0 AS u10, 25.0e0 - min(l_quantity) AS v10, max(l_tax) AS tp
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "v_fc_pl": """
SELECT TIMESTAMP '2024-01-01 00:00:00' + (INTERVAL '1' DAY) * (l_orderkey % 60) AS time,
       CAST(l_linenumber * 3 AS DOUBLE) AS step,
       CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN 250 WHEN 1 THEN 500 WHEN 2 THEN 850 ELSE 1000 END AS level,
       -26.0e0 - 0.25e0 * CAST(l_partkey % 3 AS DOUBLE) AS latitude, 113.0e0 + 0.25e0 * CAST(l_suppkey % 5 AS DOUBLE) AS longitude,
       273.15e0 + max(l_quantity) AS t, max(l_quantity) - 25.0e0 AS u, 25.0e0 - min(l_quantity) AS v
FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "v_runs": """
SELECT DATE '2024-01-01' + CAST(d AS INT) AS file_date, time, step, latitude, longitude, t2m
FROM (SELECT time, step, latitude, longitude, t2m, (dayofyear(time) - 1) - (dayofyear(time) - 1) % 7 AS d FROM v_fc) f
UNION ALL
SELECT DATE '2024-01-01' + CAST(d - 7 AS INT), time, step, latitude, longitude, t2m + 1.0e0
FROM (SELECT time, step, latitude, longitude, t2m, (dayofyear(time) - 1) - (dayofyear(time) - 1) % 7 AS d FROM v_fc) f
WHERE d >= 7 AND (dayofyear(time) - 1) % 7 < 3""",
}

_DEPS = {"v_runs": ["v_fc"]}
_ORDER = ["v_stations", "v_obs", "v_series15", "v_era5", "v_fc", "v_fc_pl", "v_runs"]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every fixture view it mentions."""
    used = {v for v in _ORDER if re.search(rf"\b{v}\b", sql)}
    for v in list(used):
        used.update(_DEPS.get(v, []))
    if not used:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in _ORDER if v in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
