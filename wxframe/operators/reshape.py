"""Reshaping: long/wide, station cube, per-time frames, 2-D fields, GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import flip_angle, null_nonfinite, wind_angle, wind_speed
from . import select as S


def to_long(df: DataFrame, keys, variables=None, name: str = "variable",
            value: str = "value", drop_nulls: bool = False) -> DataFrame:
    """Wide -> long: one row per (keys, variable)."""
    keys = list(keys)
    variables = [c for c in (variables or df.columns) if c not in keys]
    out = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in variables]) \
        .unpivot(keys, variables, name, value)
    return out.where(F.col(value).isNotNull()) if drop_nulls else out


def to_wide(df: DataFrame, keys, variables, name: str = "variable", value: str = "value",
            order_col: str | None = None) -> DataFrame:
    """Long -> wide by conditional aggregation over a known variable list.

    A known list avoids pivot's extra distinct job; with ``order_col`` the
    first row in that order wins a duplicate, otherwise the maximum.
    """
    aggs = []
    for v in variables:
        hit = F.col(name) == F.lit(v)
        if order_col:
            aggs.append(F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col(order_col))).alias(v))
        else:
            aggs.append(F.max(F.when(hit, F.col(value))).alias(v))
    return df.groupBy(*keys).agg(*aggs)


def attach_coords(obs: DataFrame, stations: DataFrame, station_col: str = "station",
                  unknown: str = "error") -> DataFrame:
    """Attach station lat/lon/code by name.

    A row whose station is not listed fails the job with the station's name, when it is met and with no job of its own;
    ``unknown='drop'`` leaves such rows out.  The stations side is left to AQE: broadcast when its measured size is
    small, shuffle join otherwise.
    """
    added = ["lat", "lon", *[c for c in ("code",) if c in stations.columns]]
    if unknown == "drop":
        return obs.join(stations.select(station_col, *added), station_col)
    met = obs.join(stations.select(station_col, F.struct(*added).alias("_at")), station_col, "left")
    lost = F.raise_error(F.concat(F.lit("no coordinates for station "), F.coalesce(F.col(station_col).cast("string"), F.lit("null"))))
    at = F.when(F.col("_at").isNotNull(), F.col("_at")).otherwise(lost.cast(met.schema["_at"].dataType))
    return met.withColumn("_at", at).select(*obs.columns, *[F.col(f"_at.{c}").alias(c) for c in added])


def unknown_stations(obs: DataFrame, stations: DataFrame, station_col: str = "station") -> DataFrame:
    """Station names present in the data but absent from the station list (an error upstream)."""
    return obs.select(station_col).distinct().join(stations.select(station_col), station_col, "left_anti")


def build_obs(obs_long: DataFrame, stations: DataFrame, variables, order_col: str = "event_id") -> DataFrame:
    """(station, time) cube with one column per variable and station coordinates attached."""
    wide = to_wide(obs_long, ["station", "time"], variables, order_col=order_col)
    return attach_coords(wide, stations)


def map_frames(obs_long: DataFrame, stations: DataFrame, variable: str, start=None, end=None,
               box=C.WA_STATION_BOX) -> DataFrame:
    """Per-time station frames in flat form: (time, station, lat, lon, value).

    Stations are restricted to the box first (on the dimension table), then
    joined to the sliced observations of one variable.
    """
    st = S.within_box(stations, box).select("station", "lat", "lon")
    obs = S.time_slice(obs_long.where(F.col("variable") == variable), start, end)
    obs = obs.select("station", "time", null_nonfinite("value").alias("value"))
    return obs.join(st, "station", "inner").select("time", "station", "lat", "lon", "value")


def frames_by_time(frames: DataFrame, value: str = "value", time_col: str = "time") -> DataFrame:
    """One row per time: ``frame``, its stations sorted by name (every column but the time, a missing value null), and
    the scale ``vmin``, ``vmax`` of ``value`` (for wind frames: of the speed).  Stations without a row at a time are
    not made up."""
    columns = ["station", *[c for c in frames.columns if c not in ("station", time_col)]]
    return frames.groupBy(time_col).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("frame"),
                                        F.min(value).alias("vmin"), F.max(value).alias("vmax"))


def value_range(frames: DataFrame, value: str = "value") -> DataFrame:
    return frames.agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))


def wind_frames(wide: DataFrame, stations: DataFrame, speed: str, direction: str,
                box=C.WA_STATION_BOX) -> DataFrame:
    """Station wind frames: speed null -> 0; 'from' angle flipped to 'to', null -> 0."""
    st = S.within_box(stations, box).select("station", "lat", "lon")
    return (wide.join(st, "station", "inner")
            .select("time", "station", "lat", "lon",
                    F.coalesce(null_nonfinite(speed), F.lit(0.0)).alias("speed"),
                    F.coalesce(flip_angle(null_nonfinite(direction)), F.lit(0.0)).alias("angle")))


def field(df: DataFrame, var: str, time_index: int, step_index: int,
          lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """2-D field at clamped (time_index, step_index) as (lat, lon, value) rows."""
    sl = S.slice_field(df, time_index, step_index)
    return sl.select(F.col(lat).alias("lat"), F.col(lon).alias("lon"), null_nonfinite(var).alias("value"))


def wind_field(df: DataFrame, u: str, v: str, time_index: int, step_index: int,
               lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    sl = S.slice_field(df, time_index, step_index)
    uu, vv = null_nonfinite(u), null_nonfinite(v)
    return sl.select(F.col(lat).alias("lat"), F.col(lon).alias("lon"),
                     wind_speed(uu, vv).alias("speed"), wind_angle(uu, vv).alias("angle"))


def field_geojson(points: DataFrame, kind: str = "scalar") -> DataFrame:
    """One GeoJSON Feature (as JSON text) per finite point.

    ``points`` is the output of :func:`field` (lat, lon, value) or of
    :func:`wind_field` (lat, lon, speed, angle).
    """
    if kind == "wind":
        pts = points.where(F.col("speed").isNotNull() & F.col("angle").isNotNull())
        props = F.struct(F.col("speed").alias("value"), F.col("angle").alias("angle_degN"),
                         F.col("speed").alias("speed"))
    else:
        pts = points.where(F.col("value").isNotNull())
        props = F.struct(F.col("value").alias("value"))
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col("lon"), F.col("lat")).alias("coordinates")).alias("geometry"),
        props.alias("properties"),
    )
    return pts.select("lat", "lon", F.to_json(feat).alias("feature"))

