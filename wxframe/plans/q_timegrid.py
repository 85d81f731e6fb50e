"""Time-grid queries on the hourly reanalysis cells (ten-day periods stand in
for month files) and on the 15-minute station series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as R
from ..operators import stats as ST
from ..operators import timegrid as TG
from ..functions.columns import round6
from .registry import Views, register

CELL = ["latitude", "longitude"]
ERA_VARS = ["t2m", "u10", "v10", "tp", "tcc"]


def _period(t: str):
    return F.least(F.floor((F.dayofmonth(t) - 1) / 10), F.lit(2)).cast("long")


def _era(v):
    return v.era5.select(*CELL, _period("valid_time").alias("period"), F.col("valid_time").alias("time"), *ERA_VARS)


_BASE_SQL = f"""SELECT latitude, longitude, CAST(least(floor((dayofmonth(valid_time) - 1) / 10), 2) AS BIGINT) AS period,
       valid_time AS time, {', '.join(ERA_VARS)} FROM v_era5"""


@register("time_grid", f"""
WITH b AS ({_BASE_SQL}),
s AS (SELECT latitude, longitude, period, min(time) AS t0, max(time) + INTERVAL 45 MINUTE AS t1 FROM b GROUP BY 1, 2, 3)
SELECT latitude, longitude, period, unnest(generate_series(t0, t1, INTERVAL 15 MINUTE)) AS time FROM s
""")
def time_grid(spark, sf_dir):
    return TG.time_grid(_era(Views(spark, sf_dir)), CELL + ["period"])


def _interp_sql(pchip=(), linear=(), spread=(), ffill=(), buffer=True) -> str:
    """DuckDB twin of interpolate_grid on the reanalysis cells."""
    part = "latitude, longitude, period"
    vs = ", ".join(ERA_VARS)
    sql = [f"b AS ({_BASE_SQL})"]
    if buffer:
        sql.append("periods AS (SELECT period AS p, min(time) AS first_t, lag(period) OVER (ORDER BY period) AS prev "
                   "FROM b GROUP BY period)")
        sql.append(f"lab AS (SELECT {part}, time, {vs}, false AS _buffer FROM b UNION ALL "
                   f"SELECT b.latitude, b.longitude, p.prev, b.time, {', '.join('b.' + v for v in ERA_VARS)}, true "
                   f"FROM b JOIN periods p ON b.period = p.p AND b.time = p.first_t WHERE p.prev IS NOT NULL)")
    else:
        sql.append(f"lab AS (SELECT {part}, time, {vs}, false AS _buffer FROM b)")
    win = f"WINDOW w AS (PARTITION BY {part} ORDER BY _x), wall AS (PARTITION BY {part})"
    s1 = ["min(CASE WHEN NOT _buffer THEN _x END) OVER wall AS _t0",
          "min(CASE WHEN NOT _buffer THEN time END) OVER wall AS _t0ts",
          "max(CASE WHEN NOT _buffer THEN _x END) OVER wall + 2700.0e0 AS _tend",
          "lead(_x) OVER w AS _x1", "lag(_x) OVER w AS _xm1", "row_number() OVER w AS _k", "count(*) OVER wall AS _n"]
    for v in linear:
        s1 += [f"lead({v}) OVER w AS _l1_{v}", f"lag({v}) OVER w AS _lm1_{v}"]
    for v in pchip:
        s1 += [f"lead({v}) OVER w AS _y1_{v}", f"lag({v}) OVER w AS _ym1_{v}",
               f"sum(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END) OVER wall AS _nn_{v}"]
    sql.append(f"s1 AS (SELECT *, {', '.join(s1)} FROM (SELECT *, epoch_us(time) / 1e6 AS _x FROM lab) {win})")
    last = "s1"
    if pchip:
        ms = ", ".join(f"(_y1_{v} - {v}) / (_x1 - _x) AS _m_{v}" for v in pchip)
        sql.append(f"s2 AS (SELECT *, _x1 - _x AS _h, {ms} FROM s1)")
        s3 = ["lag(_h) OVER w AS _hm1", "lag(_h, 2) OVER w AS _hm2", "lead(_h) OVER w AS _hp1"]
        for v in pchip:
            s3 += [f"lag(_m_{v}) OVER w AS _mm1_{v}", f"lag(_m_{v}, 2) OVER w AS _mm2_{v}", f"lead(_m_{v}) OVER w AS _mp1_{v}"]
        sql.append(f"s3 AS (SELECT *, {', '.join(s3)} FROM s2 {win})")
        ds = ", ".join(f"{_slope_sql(v)} AS _d_{v}" for v in pchip)
        sql.append(f"s4 AS (SELECT *, {ds} FROM s3)")
        s5 = ", ".join(f"lead(_d_{v}) OVER w AS _d1_{v}, lag(_d_{v}) OVER w AS _dm1_{v}" for v in pchip)
        sql.append(f"s5 AS (SELECT *, {s5} FROM s4 {win})")
        last = "s5"
    lo = "CASE WHEN _k = 1 THEN 0 ELSE CAST(ceil((_x - _t0) / 900.0e0) AS BIGINT) END"
    last_i = "CAST(floor((_tend - _t0) / 900.0e0) AS BIGINT)"
    hi = f"least(coalesce(CAST(ceil((_x1 - _t0) / 900.0e0) AS BIGINT) - 1, {last_i}), {last_i})"
    sql.append(f"e0 AS (SELECT *, {lo} AS _lo, {hi} AS _hi FROM {last} WHERE NOT _buffer)")
    sql.append("e AS (SELECT *, unnest(generate_series(_lo, greatest(_lo, _hi))) AS _i FROM e0)")
    sql.append("f AS (SELECT *, _t0 + _i * 900.0e0 AS _t FROM e WHERE _i <= _hi)")
    outs = []
    for v in ffill:
        outs.append(f"{v}")
    for v in spread:
        outs.append(f"{v} / 4.0e0 AS {v}")
    for v in linear:
        outs.append(f"""(round((CASE WHEN _t = _x AND _k > 1 THEN (({v} - _lm1_{v}) / (_x - _xm1)) * (_t - _xm1) + _lm1_{v}
     WHEN _x1 IS NULL AND _t <> _x THEN NULL
     ELSE ((_l1_{v} - {v}) / (_x1 - _x)) * (_t - _x) + {v} END) * 1e6) / 1e6) AS {v}""")
    for v in pchip:
        here = _hermite_sql("_x", v, f"_d_{v}", f"_d1_{v}", "_h", f"_m_{v}")
        prev = _hermite_sql("_xm1", f"_ym1_{v}", f"_dm1_{v}", f"_d_{v}", "_hm1", f"_mm1_{v}")
        outs.append(f"""(round((CASE WHEN _nn_{v} > 0 OR _n < 2 THEN NULL WHEN _t = _x THEN {v}
     WHEN _x1 IS NULL THEN {prev} ELSE {here} END) * 1e6) / 1e6) AS {v}""")
    fine = "_t0ts + to_microseconds(CAST(round(_i * 900.0e0 * 1e6) AS BIGINT))"
    return "WITH " + ",\n".join(sql) + f"\nSELECT {part}, {fine} AS time, {', '.join(outs)} FROM f"


def _edge_sql(h0, h1, m0, m1) -> str:
    d = f"(((2 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}))"
    return (f"(CASE WHEN sign({d}) <> sign({m0}) THEN 0.0e0 "
            f"WHEN sign({m0}) <> sign({m1}) AND abs({d}) > 3 * abs({m0}) THEN 3 * {m0} ELSE {d} END)")


def _slope_sql(v: str) -> str:
    m, mm1, mm2, mp1 = f"_m_{v}", f"_mm1_{v}", f"_mm2_{v}", f"_mp1_{v}"
    w1, w2 = "(2 * _h + _hm1)", "(_h + 2 * _hm1)"
    interior = (f"(CASE WHEN sign({mm1}) <> sign({m}) OR {mm1} = 0 OR {m} = 0 THEN 0.0e0 "
                f"ELSE 1.0e0 / (({w1} / {mm1} + {w2} / {m}) / ({w1} + {w2})) END)")
    return (f"(CASE WHEN _n < 2 THEN NULL WHEN _n = 2 AND _k = 1 THEN {m} WHEN _n = 2 THEN {mm1} "
            f"WHEN _k = 1 THEN {_edge_sql('_h', '_hp1', m, mp1)} "
            f"WHEN _k = _n THEN {_edge_sql('_hm1', '_hm2', mm1, mm2)} ELSE {interior} END)")


def _hermite_sql(xa, ya, da, db, h, m, t: str = "_t") -> str:
    tt = f"(({da} + {db} - 2 * {m}) / {h})"
    c0 = f"({tt} / {h})"
    c1 = f"(({m} - {da}) / {h} - {tt})"
    dt = f"({t} - {xa})"
    dt2 = f"({dt} * {dt})"
    return f"({ya} + {da} * {dt} + {c1} * {dt2} + {c0} * ({dt2} * {dt}))"


def _interp(spark, sf_dir, **groups):
    out = TG.interpolate_grid(_era(Views(spark, sf_dir)), CELL, "time", "period", **groups)
    rnd = list(groups.get("linear", ())) + list(groups.get("pchip", ()))
    return out.withColumns({v: round6(v) for v in rnd}) if rnd else out


@register("ffill_15min", _interp_sql(ffill=["tcc"]))
def ffill_15min(spark, sf_dir):
    return _interp(spark, sf_dir, ffill=["tcc"])


@register("precip_15min", _interp_sql(spread=["tp"]))
def precip_15min(spark, sf_dir):
    return _interp(spark, sf_dir, spread=["tp"])


@register("linear_15min", _interp_sql(linear=["u10", "v10"]))
def linear_15min(spark, sf_dir):
    return _interp(spark, sf_dir, linear=["u10", "v10"])


@register("pchip_15min", _interp_sql(pchip=["t2m"]))
def pchip_15min(spark, sf_dir):
    return _interp(spark, sf_dir, pchip=["t2m"])


@register("pchip_15min_no_buffer", _interp_sql(pchip=["t2m"], buffer=False))
def pchip_15min_no_buffer(spark, sf_dir):
    # the last file of a run has no next period: the last segment is extended
    out = TG.interpolate_grid(_era(Views(spark, sf_dir)), CELL, "time", "period", pchip=["t2m"], buffer=False)
    return out.withColumn("t2m", round6("t2m"))


@register("interp_15min_all", _interp_sql(pchip=["t2m"], linear=["u10", "v10"], spread=["tp"], ffill=["tcc"]))
def interp_15min_all(spark, sf_dir):
    return _interp(spark, sf_dir, pchip=["t2m"], linear=["u10", "v10"], spread=["tp"], ffill=["tcc"])


def _densify_sql() -> str:
    part = "station, variable"
    win = f"WINDOW w AS (PARTITION BY {part} ORDER BY _x), wall AS (PARTITION BY {part})"
    long = ("SELECT station, time, 'airTemperature' AS variable, airTemperature AS value FROM v_series15 UNION ALL "
            "SELECT station, time, 'solarExposure', solarExposure FROM v_series15")
    return f"""WITH l AS ({long}),
s AS (SELECT *, floor(min(_x) OVER wall / 300.0e0) * 300.0e0 AS _g0, floor(max(_x) OVER wall / 300.0e0) * 300.0e0 AS _g1
      FROM (SELECT *, epoch_us(time) / 1e6 AS _x FROM l WHERE value IS NOT NULL) {win}),
k0 AS (SELECT * FROM s WHERE _x = floor(_x / 300.0e0) * 300.0e0),
k1 AS (SELECT *, lead(_x) OVER w AS _x1, lag(_x) OVER w AS _xm1, lead(value) OVER w AS _y1, lag(value) OVER w AS _ym1,
              row_number() OVER w AS _k, count(*) OVER wall AS _n FROM k0 {win}),
k2 AS (SELECT *, _x1 - _x AS _h, (_y1 - value) / (_x1 - _x) AS _m FROM k1),
k3 AS (SELECT *, lag(_h) OVER w AS _hm1, lag(_h, 2) OVER w AS _hm2, lead(_h) OVER w AS _hp1,
              lag(_m) OVER w AS _mm1_value, lag(_m, 2) OVER w AS _mm2_value, lead(_m) OVER w AS _mp1_value FROM k2 {win}),
k4 AS (SELECT *, {_slope_sql('value').replace('_m_value', '_m')} AS _d FROM (SELECT *, _m AS _m_value FROM k3)),
k5 AS (SELECT *, lead(_d) OVER w AS _d1, lag(_d) OVER w AS _dm1 FROM k4 {win}),
e0 AS (SELECT *, CASE WHEN _k = 1 THEN 0 ELSE CAST(round((_x - _g0) / 300.0e0) AS BIGINT) END AS _lo,
              least(coalesce(CAST(round((_x1 - _g0) / 300.0e0) AS BIGINT) - 1, CAST(round((_g1 - _g0) / 300.0e0) AS BIGINT)),
                    CAST(round((_g1 - _g0) / 300.0e0) AS BIGINT)) AS _hi FROM k5),
e AS (SELECT *, unnest(generate_series(_lo, greatest(_lo, _hi))) AS _i FROM e0),
f AS (SELECT *, _g0 + _i * 300.0e0 AS _t FROM e WHERE _i <= _hi)
SELECT station, variable, make_timestamp(CAST(round(_t * 1e6) AS BIGINT)) AS time,
       (round((CASE WHEN _t = _x THEN value WHEN _t < _x THEN NULL WHEN _n < 2 THEN NULL
                  WHEN _x1 IS NULL THEN {_hermite_sql('_xm1', '_ym1', '_dm1', '_d', '_hm1', '_mm1_value')}
                  ELSE {_hermite_sql('_x', 'value', '_d', '_d1', '_h', '_m')} END) * 1e6) / 1e6) AS value
FROM f"""


def _densify(v):
    long = R.to_long(v.series15, ["station", "time"], ["airTemperature", "solarExposure"])
    out = TG.densify_pchip(long, ["station", "variable"], step_minutes=5)
    return out.withColumn("value", round6("value"))


@register("densify_5min", _densify_sql())
def densify_5min(spark, sf_dir):
    return _densify(Views(spark, sf_dir))


@register("compare_resolution", f"""
WITH a AS (SELECT count(DISTINCT time) AS steps_a, count(DISTINCT station) AS stations_a, count(*) AS points_a
           FROM v_series15),
b AS (SELECT count(DISTINCT time) AS steps_b, count(DISTINCT station) AS stations_b, count(*) AS points_b
      FROM ({_densify_sql()}))
SELECT *, round(points_b / points_a * 1e6) / 1e6 AS growth FROM a, b
""")
def compare_resolution(spark, sf_dir):
    v = Views(spark, sf_dir)
    return ST.compare_resolution(v.series15, _densify(v))
