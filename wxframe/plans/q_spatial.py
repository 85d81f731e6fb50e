"""Spatial queries: cell grid, extent polygon, projection, inverse-distance
fill, observation/forecast overlay and hull."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import round6
from ..operators import lattice as L
from ..operators import select as S
from ..operators import spatial as G
from ..operators import units as U
from .registry import Views, register
from .sqlfrag import albers_xy, lit, r6

DLAT = C.GRID_SIZE_KM / C.KM_PER_DEGREE


@register("build_grid", f"""
WITH e AS (SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM v_stations),
r AS (SELECT lon_min, lon_max, lat_min + {lit(DLAT / 2)} AS s,
             unnest(generate_series(0, CAST(ceil((lat_max - (lat_min + {lit(DLAT / 2)})) / {lit(DLAT)}) - 1 AS BIGINT))) AS row
      FROM e),
r2 AS (SELECT *, s + row * {lit(DLAT)} AS lat FROM r),
r3 AS (SELECT *, {lit(C.GRID_SIZE_KM)} / ({lit(C.KM_PER_DEGREE)} * cos(radians(lat))) AS dlon FROM r2),
r4 AS (SELECT *, lon_min + dlon / 2 AS ls FROM r3),
c AS (SELECT *, unnest(generate_series(0, CAST(ceil((lon_max - ls) / dlon) - 1 AS BIGINT))) AS col FROM r4)
SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, {r6('lat')} AS lat, {r6('ls + col * dlon')} AS lon,
       {r6(f'lat - {lit(DLAT / 2)}')} AS lat_s, {r6(f'lat + {lit(DLAT / 2)}')} AS lat_n,
       {r6('ls + col * dlon - dlon / 2')} AS lon_w, {r6('ls + col * dlon + dlon / 2')} AS lon_e
FROM c
""")
def build_grid(spark, sf_dir):
    # the grid covers the extent of the station table (data-derived box)
    g = G.build_grid(S.extent(Views(spark, sf_dir).stations))
    return g.select("row", "col", *[round6(c).alias(c) for c in ("lat", "lon", "lat_s", "lat_n", "lon_w", "lon_e")])


@register("extent_polygon", """
WITH e AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM v_stations)
SELECT 0 AS corner, a AS lat, c AS lon FROM e UNION ALL SELECT 1, a, d FROM e
UNION ALL SELECT 2, b, d FROM e UNION ALL SELECT 3, b, c FROM e
""")
def extent_polygon(spark, sf_dir):
    return G.extent_polygon(Views(spark, sf_dir).stations)


_X, _Y = albers_xy("lat", "lon")


@register("project_albers", f"SELECT station, {r6(_X)} AS x, {r6(_Y)} AS y FROM v_stations")
def project_albers(spark, sf_dir):
    p = G.project(Views(spark, sf_dir).stations)
    return p.select("station", round6("x").alias("x"), round6("y").alias("y"))


@register("albers_roundtrip", "SELECT station, round(lat * 1e6) / 1e6 AS lat, round(lon * 1e6) / 1e6 AS lon FROM v_stations")
def albers_roundtrip(spark, sf_dir):
    # forward then inverse projection returns the input to well below a micro-degree
    p = G.unproject(G.project(Views(spark, sf_dir).stations).select("station", "x", "y"), "x", "y", "lat", "lon")
    return p.select("station", round6("lat").alias("lat"), round6("lon").alias("lon"))


def _idw_inputs(v):
    """Fill points (the forecast cells, named by their coordinates), stations, and observations at their own times."""
    points = v.fc.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()
    name = F.round(F.col("lat") * 100).cast("long") * 100000 + F.round(F.col("lon") * 100).cast("long")
    return (points.withColumn("point_id", name), S.within_box(v.stations, C.WA_STATION_BOX),
            v.obs.where(F.col("variable") == "airTemperature"))


def _idw_sql() -> str:
    px, py = albers_xy("p.lat", "p.lon")
    sx, sy = albers_xy("s.lat", "s.lon")
    return f"""
WITH p AS (SELECT DISTINCT latitude AS lat, longitude AS lon FROM v_fc),
s AS (SELECT station, lat, lon FROM v_stations
      WHERE lat BETWEEN -35.0e0 AND -13.0e0 AND lon BETWEEN 115.0e0 AND 129.0e0),
pp AS (SELECT CAST(round(lat * 100) AS BIGINT) * 100000 + CAST(round(lon * 100) AS BIGINT) AS point_id,
              {px} AS px, {py} AS py FROM p),
ss AS (SELECT station, {sx} AS sx, {sy} AS sy FROM s),
w AS (SELECT point_id, station, sqrt((px - sx) * (px - sx) + (py - sy) * (py - sy)) AS d FROM pp, ss),
w2 AS (SELECT *, 1.0e0 / pow(d + 1e-06, 2.0e0) AS wt, d < 1e-06 AS exact FROM w),
o AS (SELECT station, time, value FROM v_obs WHERE variable = 'airTemperature' AND value IS NOT NULL)
SELECT o.time, w2.point_id,
       {r6('coalesce(arg_min(o.value, w2.station) FILTER (WHERE w2.exact), sum(w2.wt * o.value) / sum(w2.wt))')} AS value
FROM o JOIN w2 ON o.station = w2.station GROUP BY 1, 2
"""


@register("idw_fill", _idw_sql())
def idw_fill(spark, sf_dir):
    points, st, obs = _idw_inputs(Views(spark, sf_dir))
    return G.idw(obs, points, st).withColumn("value", round6("value"))


_FC_AREA_STATIONS = """SELECT 'S' || CAST(c_custkey AS VARCHAR(20)) AS station,
       -26.0e0 - CAST(c_custkey % 31 AS DOUBLE) / 40.0e0 AS lat, 113.0e0 + CAST(c_custkey % 41 AS DOUBLE) / 40.0e0 AS lon
FROM customer"""


def _fc_area_stations(spark, sf_dir):
    # stations placed inside the forecast grid's area so observations meet forecast cells
    from ..sources.fixtures import table
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("S"), k.cast("string")).alias("station"),
                    (F.lit(-26.0) - (k % 31).cast("double") / 40.0).alias("lat"),
                    (F.lit(113.0) + (k % 41).cast("double") / 40.0).alias("lon"))


@register("overlay", f"""
WITH st AS (SELECT station, round(lat / 0.25e0) * 0.25e0 AS latitude, round(lon / 0.25e0) * 0.25e0 AS longitude
            FROM ({_FC_AREA_STATIONS})),
o AS (SELECT o.station, o.time, o.value, date_trunc('hour', o.time) AS valid_time, st.latitude, st.longitude
      FROM v_obs o JOIN st ON o.station = st.station WHERE o.variable = 'airTemperature'),
fc AS (SELECT latitude, longitude, time AS run_time, step, time + to_microseconds(CAST(round(step * 3600e6) AS BIGINT)) AS valid_time,
              CASE WHEN abs(t2m - 9999.0e0) <= 1e-08 + 1e-05 * 9999.0e0 THEN NULL ELSE t2m END - 273.15e0 AS fc FROM v_fc),
l AS (SELECT latitude, longitude, valid_time, max(run_time) AS run_time FROM fc GROUP BY 1, 2, 3)
SELECT o.station, o.time, o.value, o.latitude, o.longitude, o.valid_time, fc.run_time, fc.step, fc.fc AS forecast,
       o.value - fc.fc AS diff
FROM o JOIN l ON o.latitude = l.latitude AND o.longitude = l.longitude AND o.valid_time = l.valid_time
JOIN fc ON fc.latitude = l.latitude AND fc.longitude = l.longitude AND fc.valid_time = l.valid_time AND fc.run_time = l.run_time
""")
def overlay(spark, sf_dir):
    v = Views(spark, sf_dir)
    fc = U.null_missing(v.fc, {"t2m": 9999.0}).withColumn("t2m", F.col("t2m") - 273.15)
    return G.overlay(v.obs, _fc_area_stations(spark, sf_dir), fc, "airTemperature", "t2m")


def _wa_stations(v):
    return S.within_box(v.stations, C.WA_STATION_BOX)


# corners: of the lowest and highest place per longitude, the starts of directed pairs that have every other place on
# their left or between them; the lower chain runs east, then the upper one west
_HULL_CTE = """
s AS (SELECT lon, lat, min(station) AS station FROM v_stations
      WHERE lat BETWEEN -35.0e0 AND -13.0e0 AND lon BETWEEN 115.0e0 AND 129.0e0
        AND station NOT IN ('Broome (Skuthorpe)', 'Kununurra') GROUP BY 1, 2),
c AS (SELECT s.* FROM s JOIN (SELECT lon, min(lat) AS lo, max(lat) AS hi FROM s GROUP BY 1) m ON s.lon = m.lon
      WHERE s.lat = m.lo OR s.lat = m.hi),
t AS (SELECT p.station, q.station AS next, (q.lon - p.lon) * (r.lat - p.lat) - (q.lat - p.lat) * (r.lon - p.lon) AS turn,
             (q.lon - p.lon) * (r.lon - p.lon) + (q.lat - p.lat) * (r.lat - p.lat) AS along,
             (q.lon - p.lon) * (q.lon - p.lon) + (q.lat - p.lat) * (q.lat - p.lat) AS len
      FROM c p, c q, c r WHERE p.station <> q.station),
v AS (SELECT station FROM t GROUP BY station, next
      HAVING bool_and(turn > 1e-12 OR (abs(turn) <= 1e-12 AND along >= -1e-12 AND along <= len + 1e-12))),
ends AS (SELECT min(row(lon, lat)) AS a, max(row(lon, lat)) AS b FROM c),
h AS (SELECT c.*, (b[1] - a[1]) * (lat - a[2]) - (b[2] - a[2]) * (lon - a[1]) > 1e-12 AS upper
      FROM c, ends WHERE station IN (SELECT station FROM v))"""


@register("convex_hull", f"""
WITH {_HULL_CTE}
SELECT CAST(row_number() OVER (ORDER BY upper, CASE WHEN upper THEN -lon ELSE lon END, CASE WHEN upper THEN -lat ELSE lat END) - 1
            AS BIGINT) AS seq, station, lat, lon, CAST(count(*) OVER () AS BIGINT) AS n_vertices,
       CASE WHEN count(*) OVER () = 2 THEN 'polyline' ELSE 'polygon' END AS hull_type
FROM h
""")
def convex_hull(spark, sf_dir):
    return G.convex_hull(_wa_stations(Views(spark, sf_dir)))


@register("hull_interior", f"""
WITH {_HULL_CTE}
SELECT * FROM v_stations WHERE lat BETWEEN -35.0e0 AND -13.0e0 AND lon BETWEEN 115.0e0 AND 129.0e0
  AND station NOT IN ('Broome (Skuthorpe)', 'Kununurra') AND station NOT IN (SELECT station FROM h)
""")
def hull_interior(spark, sf_dir):
    st = _wa_stations(Views(spark, sf_dir))
    return G.hull_interior(st, G.convex_hull(st))


def _fill_cte() -> str:
    """CTE ``taken``: the fill lattice in scan order.  The outline is the projected hull; its box comes from the crossings
    of all pairs of parallels that lie in the shrunk outline; the points of a row are taken one after the other."""
    r, reach = lit(C.FILL_RADIUS_M), lit(C.FILL_RADIUS_M * C.FILL_MIN_SEPARATION)
    dx, dy = (lit(v) for v in L.spacing(C.FILL_RADIUS_M, C.FILL_PACKING_SCALE))
    x, y = albers_xy("lat", "lon")

    def inside(points: str, keys: str) -> str:
        return f"""SELECT {keys} FROM {points} p, e GROUP BY {keys}
  HAVING min(sqrt(pow(p.x - ax - greatest(0, least(1, ((p.x - ax) * ex + (p.y - ay) * ey) / (l * l))) * ex, 2)
                + pow(p.y - ay - greatest(0, least(1, ((p.x - ax) * ex + (p.y - ay) * ey) / (l * l))) * ey, 2))) >= {r} * (1 - 1e-7)
     AND count(*) FILTER (WHERE (ay <= p.y) <> (ay + ey <= p.y) AND ax + (p.y - ay) / ey * ex > p.x) % 2 = 1"""

    return f"""{_HULL_CTE.strip()},
ring AS (SELECT row_number() OVER (ORDER BY upper, CASE WHEN upper THEN -lon ELSE lon END, CASE WHEN upper THEN -lat ELSE lat END) AS k,
                count(*) OVER () AS n, {x} AS x, {y} AS y FROM h),
e AS (SELECT p.k, p.x AS ax, p.y AS ay, q.x - p.x AS ex, q.y - p.y AS ey, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) AS l
      FROM ring p JOIN ring q ON q.k = p.k % p.n + 1),
o AS (SELECT *, ax - {r} * ey / l AS ox, ay + {r} * ex / l AS oy FROM e),
cross_at AS (SELECT i.k * 100000 + j.k AS k, i.ox + ((j.ox - i.ox) * j.ey - (j.oy - i.oy) * j.ex) / (i.ex * j.ey - i.ey * j.ex) * i.ex AS x,
                    i.oy + ((j.ox - i.ox) * j.ey - (j.oy - i.oy) * j.ex) / (i.ex * j.ey - i.ey * j.ex) * i.ey AS y
             FROM o i, o j WHERE i.k < j.k AND i.ex * j.ey - i.ey * j.ex <> 0),
box AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ({inside("cross_at", "p.k, p.x, p.y")})),
lattice AS (SELECT row, x0 - {dx} + CASE row % 2 WHEN 1 THEN {r} ELSE 0 END AS start, x1, y0 + row * {dy} AS y
            FROM (SELECT *, unnest(generate_series(0, CAST(floor((y1 - y0) / {dy}) AS BIGINT))) AS row FROM box)),
cand AS (SELECT row, col, start + col * {dx} AS x, y
         FROM (SELECT *, unnest(generate_series(0, CAST(ceil((x1 - start) / {dx}) AS BIGINT))) AS col FROM lattice)),
near_st AS (SELECT {x} AS sx, {y} AS sy FROM v_stations
            WHERE lat BETWEEN -35.0e0 AND -13.0e0 AND lon BETWEEN 115.0e0 AND 129.0e0),
free AS (SELECT * FROM ({inside("cand", "p.row, p.col, p.x, p.y")}) c
         WHERE NOT EXISTS (SELECT 1 FROM near_st WHERE pow(c.x - sx, 2) + pow(c.y - sy, 2) < {reach} * {reach})),
line AS (SELECT row_number() OVER (ORDER BY row) AS n, row, y, list([struct_pack(row := row, col := col, x := x, y := y)] ORDER BY col) AS points
         FROM free GROUP BY row, y),
scan AS (
  SELECT CAST(0 AS BIGINT) AS n, 0.0e0 AS y, CAST([] AS STRUCT(row BIGINT, col BIGINT, x DOUBLE, y DOUBLE)[]) AS stay
  UNION ALL
  SELECT l.n, l.y, list_reduce(l.points, lambda s, c: CASE WHEN
      len(list_filter(s, lambda p: abs(p.x - c[1].x) < {reach} AND (p.x - c[1].x) * (p.x - c[1].x) + (p.y - c[1].y) * (p.y - c[1].y) < {lit((C.FILL_RADIUS_M * C.FILL_MIN_SEPARATION) ** 2)})) = 0
      THEN list_concat(s, c) ELSE s END, list_filter(g.stay, lambda p: p.y > l.y - {reach}))
  FROM scan g JOIN line l ON l.n = g.n + 1
),
stays AS (SELECT unnest(list_filter(stay, lambda p: p.y = scan.y)) AS p FROM scan),
taken AS (SELECT row_number() OVER (ORDER BY p.row, p.col) - 1 AS fill_id, p.row AS row, p.col AS col, p.x AS x, p.y AS y FROM stays)"""


@register("fill_points", f"""
WITH RECURSIVE {_fill_cte()}
SELECT CAST(fill_id AS BIGINT) AS fill_id, 0 AS part, row, col, round(x * 1e3) / 1e3 AS x, round(y * 1e3) / 1e3 AS y FROM taken
""")
def fill_points(spark, sf_dir):
    st = _wa_stations(Views(spark, sf_dir))
    out = L.fill_points(G.convex_hull(st), st)
    return out.select("fill_id", "part", "row", "col", *[(F.round(F.col(c) * 1e3) / 1e3).alias(c) for c in ("x", "y")])


def _lattice_idw_sql() -> str:
    sx, sy = albers_xy("lat", "lon")
    return f"""
WITH RECURSIVE {_fill_cte()},
ss AS (SELECT station, {sx} AS sx, {sy} AS sy FROM v_stations
       WHERE lat BETWEEN -35.0e0 AND -13.0e0 AND lon BETWEEN 115.0e0 AND 129.0e0),
w AS (SELECT fill_id, station, 1.0e0 / pow(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) + 1e-06, 2.0e0) AS wt FROM taken, ss),
d AS (SELECT station, date_trunc('day', time) AS time, avg(value) AS value FROM v_obs
      WHERE variable = 'airTemperature' AND value IS NOT NULL GROUP BY 1, 2)
SELECT CAST(d.time AS TIMESTAMP) AS time, CAST(fill_id AS BIGINT) AS point_id, {r6('sum(wt * d.value) / sum(wt)')} AS value
FROM d JOIN w ON d.station = w.station GROUP BY 1, 2
"""


@register("idw_fill_lattice", _lattice_idw_sql())
def idw_fill_lattice(spark, sf_dir):
    # hull -> fill lattice -> inverse-distance values of daily station means; no station is on a fill point
    v = Views(spark, sf_dir)
    st = _wa_stations(v)
    points = L.fill_points(G.convex_hull(st), st).select(F.col("fill_id").alias("point_id"), "lat", "lon")
    daily = v.obs.where(F.col("variable") == "airTemperature") \
        .groupBy("station", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time")).agg(F.avg("value").alias("value"))
    return G.idw(daily, points, st).withColumn("value", round6("value"))
