"""Level flattening, member alignment, forecast clean chain, run catalog and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import levels as L
from ..operators import merge as M
from ..operators import select as S
from ..operators import units as U
from .registry import Views, register

FC_KEYS = ["time", "step", "latitude", "longitude"]
PL_VARS = ["t", "u", "v"]


def _flatten_sql(levels=C.FORECAST_LEVELS) -> str:
    cols = ",\n  ".join(f"max({v}) FILTER (WHERE level = {lv}) AS {v}{lv}" for v in PL_VARS for lv in levels)
    return f"SELECT time, step, latitude, longitude,\n  {cols}\nFROM v_fc_pl GROUP BY 1, 2, 3, 4"


def _flat_pl(v):
    return L.flatten_levels(v.fc_pl, FC_KEYS, PL_VARS, C.FORECAST_LEVELS)


@register("flatten_levels", _flatten_sql())
def flatten_levels(spark, sf_dir):
    return _flat_pl(Views(spark, sf_dir))


NEAR_TARGETS = [1000, 700, 300]


def _nearest_sql() -> str:
    near = ", ".join(
        f"(SELECT arg_min(level, abs(level - {t}) * 100000 + level) FROM (SELECT DISTINCT level FROM v_fc_pl)) AS n{t}"
        for t in NEAR_TARGETS)
    cols = ",\n  ".join(f"max(p.{v}) FILTER (WHERE p.level = n.n{t}) AS {v}{t}" for v in PL_VARS for t in NEAR_TARGETS)
    return (f"SELECT p.time, p.step, p.latitude, p.longitude,\n  {cols}\n"
            f"FROM v_fc_pl p, (SELECT {near}) n GROUP BY 1, 2, 3, 4")


@register("flatten_levels_nearest", _nearest_sql())
def flatten_levels_nearest(spark, sf_dir):
    v = Views(spark, sf_dir)
    return L.flatten_levels_nearest(v.fc_pl, FC_KEYS, PL_VARS, NEAR_TARGETS)


@register("nearest_level_table", " UNION ALL ".join(
    f"SELECT {t} AS target, (SELECT arg_min(level, abs(level - {t}) * 100000 + level) "
    f"FROM (SELECT DISTINCT level FROM v_fc_pl)) AS level_used" for t in NEAR_TARGETS))
def nearest_level_table(spark, sf_dir):
    v = Views(spark, sf_dir)
    return L.nearest_level_table(v.fc_pl, NEAR_TARGETS)


ERA_KEYS = ["valid_time", "latitude", "longitude"]


def _era_members(v):
    e = v.era5
    accum = e.select(*ERA_KEYS, "tp")
    instant = e.select(*ERA_KEYS, "t2m", "u10", "v10", "tcc")
    pressure = e.select(*ERA_KEYS, (F.col("tcc") * 100.0).alias("r1000"), (F.col("tp") * 2.0).alias("tp"))
    return accum, instant, pressure


@register("align_merge_3", """
SELECT a.valid_time, a.latitude, a.longitude, a.tp, i.t2m, i.u10, i.v10, i.tcc, p.r1000
FROM (SELECT valid_time, latitude, longitude, tp FROM v_era5) a
JOIN (SELECT valid_time, latitude, longitude, t2m, u10, v10, tcc FROM v_era5) i
  ON a.valid_time = i.valid_time AND a.latitude = i.latitude AND a.longitude = i.longitude
JOIN (SELECT valid_time, latitude, longitude, tcc * 100.0e0 AS r1000 FROM v_era5) p
  ON a.valid_time = p.valid_time AND a.latitude = p.latitude AND a.longitude = p.longitude
""")
def align_merge_3(spark, sf_dir):
    return M.align_merge(_era_members(Views(spark, sf_dir)), ERA_KEYS)


def _merge2_sql() -> str:
    pl_cols = ", ".join(f"p.{v}{lv}" for v in PL_VARS for lv in C.FORECAST_LEVELS)
    return f"""
SELECT s.*, {pl_cols}
FROM (SELECT * FROM v_fc) s JOIN ({_flatten_sql()}) p
  ON s.time = p.time AND s.step = p.step AND s.latitude = p.latitude AND s.longitude = p.longitude
"""


@register("align_merge_2", _merge2_sql())
def align_merge_2(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.align_merge([v.fc, _flat_pl(v)], FC_KEYS)


def forecast_clean(fc, fc_pl):
    """Forecast run clean chain: sentinel -> flatten levels -> align -> units -> drop -> select."""
    single = U.null_missing(fc, {"t2m": 9999.0})
    flat = L.flatten_levels(fc_pl, FC_KEYS, PL_VARS, C.FORECAST_LEVELS)
    merged = M.align_merge([single, flat], FC_KEYS)
    conv, _units = U.convert_units(merged, C.FORECAST_UNIT_GROUPS, match="levels")
    conv = S.drop_coords(conv, C.FORECAST_DROP_COORDS)
    return S.select_variables(conv, FC_KEYS, C.FORECAST_VARS)


def _clean_sql() -> str:
    conv = {"t2m": "CASE WHEN abs(s.t2m - 9999.0e0) <= 1e-08 + 1e-05 * 9999.0e0 THEN NULL ELSE s.t2m END - 273.15e0",
            "msl": "s.msl / 100.0e0", "u10": "s.u10 * 3.6e0", "v10": "s.v10 * 3.6e0", "tp": "s.tp * 1000.0e0"}
    for lv in C.FORECAST_LEVELS:
        conv[f"t{lv}"] = f"p.t{lv} - 273.15e0"
        conv[f"u{lv}"] = f"p.u{lv} * 3.6e0"
        conv[f"v{lv}"] = f"p.v{lv} * 3.6e0"
    cols = ", ".join(f"{conv[c]} AS {c}" for c in C.FORECAST_VARS if c in conv)
    return f"""
SELECT s.time, s.step, s.latitude, s.longitude, {cols}
FROM v_fc s JOIN ({_flatten_sql()}) p
  ON s.time = p.time AND s.step = p.step AND s.latitude = p.latitude AND s.longitude = p.longitude
"""


@register("select_convert_units_op", _clean_sql())
def select_convert_units_op(spark, sf_dir):
    v = Views(spark, sf_dir)
    return forecast_clean(v.fc, v.fc_pl)


@register("load_date_range", """
SELECT * FROM v_runs
WHERE file_date <= DATE '2024-02-05' AND file_date >= DATE '2024-01-13'
  AND time >= TIMESTAMP '2024-01-20 00:00:00' AND time < TIMESTAMP '2024-02-06 00:00:00'
""")
def load_date_range(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.load_date_range(v.runs, "2024-01-20", "2024-02-05")


@register("dedupe_runs", """
SELECT r.* FROM v_runs r
JOIN (SELECT time, min(file_date) AS fd FROM v_runs GROUP BY time) m ON r.time = m.time AND r.file_date = m.fd
""")
def dedupe_runs(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.dedupe_runs(v.runs)


@register("available_dates", "SELECT DISTINCT strftime(file_date, '%Y-%m-%d') AS run_date FROM v_runs")
def available_dates(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.available_dates(v.runs)


@register("available_dates_limit", """
SELECT run_date FROM (SELECT DISTINCT strftime(file_date, '%Y-%m-%d') AS run_date FROM v_runs)
ORDER BY run_date LIMIT 5
""")
def available_dates_limit(spark, sf_dir):
    # first few dates, as listed in an error message (the limit is the feature)
    v = Views(spark, sf_dir)
    return M.available_dates(v.runs).orderBy("run_date").limit(5)


RE_PL_VARS = ["r", "q", "w"]


def reanalysis_clean(accum, instant, pressure, keys=("valid_time", "latitude", "longitude"),
                     targets=C.NEAREST_TARGET_LEVELS, level_col="level"):
    """Reanalysis month clean chain: nearest-level flatten of the pressure
    member -> inner align of the three members -> units -> drop -> select."""
    keys = list(keys)
    flat = L.flatten_levels_nearest(pressure, keys, RE_PL_VARS, targets, level_col)
    merged = M.align_merge([accum, instant, flat], keys)
    conv, _units = U.convert_units(merged, C.REANALYSIS_UNIT_GROUPS, match="exact")
    return S.select_variables(conv, keys, C.REANALYSIS_VARS)


def _era_pressure(v):
    from ..functions.columns import add_hours
    p = v.fc_pl
    return p.select(add_hours("time", F.col("step")).alias("valid_time"), "level", "latitude", "longitude",
                    F.col("t").alias("r"), F.col("u").alias("q"), F.col("v").alias("w"))


def _reanalysis_sql() -> str:
    targets = C.NEAREST_TARGET_LEVELS
    near = ", ".join(
        f"(SELECT arg_min(level, abs(level - {t}) * 100000 + level) FROM (SELECT DISTINCT level FROM pt)) AS n{t}"
        for t in targets)
    flat_cols = ",\n  ".join(f"max(p.{v}) FILTER (WHERE p.level = n.n{t}) AS {v}{t}" for v in RE_PL_VARS for t in targets)
    order = [c for c in C.REANALYSIS_VARS if c in {"t2m", "tcc", "u10", "v10", "tp"} | {f"{v}{t}" for v in RE_PL_VARS for t in targets}]
    conv = {"t2m": "i.t2m - 273.15e0", "u10": "i.u10 * 3.6e0", "v10": "i.v10 * 3.6e0", "tp": "a.tp * 1000.0e0",
            "tcc": "i.tcc"}
    sel = ", ".join(f"{conv.get(c, 'f.' + c)} AS {c}" for c in order)
    return f"""
WITH pt AS (SELECT time + to_microseconds(CAST(round(step * 3600e6) AS BIGINT)) AS valid_time, level, latitude, longitude,
                   t AS r, u AS q, v AS w FROM v_fc_pl),
f AS (SELECT p.valid_time, p.latitude, p.longitude,
  {flat_cols}
  FROM pt p, (SELECT {near}) n GROUP BY 1, 2, 3)
SELECT a.valid_time, a.latitude, a.longitude, {sel}
FROM (SELECT valid_time, latitude, longitude, tp FROM v_era5) a
JOIN (SELECT valid_time, latitude, longitude, t2m, u10, v10, tcc FROM v_era5) i
  ON a.valid_time = i.valid_time AND a.latitude = i.latitude AND a.longitude = i.longitude
JOIN f ON a.valid_time = f.valid_time AND a.latitude = f.latitude AND a.longitude = f.longitude
"""


@register("reanalysis_clean", _reanalysis_sql())
def reanalysis_clean_q(spark, sf_dir):
    v = Views(spark, sf_dir)
    e = v.era5
    accum = e.select(*ERA_KEYS, "tp")
    instant = e.select(*ERA_KEYS, "t2m", "u10", "v10", "tcc")
    return reanalysis_clean(accum, instant, _era_pressure(v))


@register("asof_obs_reanalysis", """
WITH o AS (SELECT *, CAST(substr(station, 2) AS BIGINT) % 5 AS c FROM v_obs WHERE variable = 'airTemperature'),
e AS (SELECT CAST(round((-26.0e0 - latitude) / 0.25e0) AS BIGINT) AS c, valid_time, t2m FROM v_era5)
SELECT o.station, o.time, o.variable, o.value, o.event_id, o.c, e.valid_time AS valid_time_matched, e.t2m
FROM o ASOF LEFT JOIN e ON o.c = e.c AND o.time >= e.valid_time
""")
def asof_obs_reanalysis(spark, sf_dir):
    # each observation takes the latest hourly reanalysis label at or before it (station -> cell by id)
    v = Views(spark, sf_dir)
    obs = (v.obs.where(F.col("variable") == "airTemperature")
           .withColumn("c", F.substring("station", 2, 20).cast("long") % 5))
    era = v.era5.select(F.round((F.lit(-26.0) - F.col("latitude")) / 0.25).cast("long").alias("c"), "valid_time", "t2m")
    return M.asof_join(obs, era, ["c"], "time", "valid_time", ["t2m"])
