"""Projections, filters and predicates (variable selection, slices, boxes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import is_bare_date, null_nonfinite, ts_lit


class NoVariablesError(ValueError):
    pass


def present_variables(df: DataFrame, wanted) -> tuple[list[str], list[str]]:
    """Split the wanted variable names into (present, missing) by the schema."""
    have = set(df.columns)
    present = [v for v in wanted if v in have]
    missing = [v for v in wanted if v not in have]
    return present, missing


def select_variables(df: DataFrame, keys, wanted, strict_empty: bool = True) -> DataFrame:
    """Keep ``keys`` plus the wanted variables that exist; absent ones are skipped.

    With ``strict_empty`` an error is raised when none of them exists.
    """
    present, _missing = present_variables(df, wanted)
    if strict_empty and not present:
        raise NoVariablesError(f"none of the variables {list(wanted)} is present")
    return df.select(*[k for k in keys if k in df.columns], *present)


def drop_coords(df: DataFrame, names) -> DataFrame:
    """Drop coordinate columns when present (absent names are ignored)."""
    return df.drop(*names)


def time_slice(df: DataFrame, start=None, end=None, time_col: str = "time") -> DataFrame:
    """Inclusive slice on a time column; a bare end date covers that whole day."""
    t = F.col(time_col)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (t >= ts_lit(start))
    if end is not None:
        if is_bare_date(end):
            cond = cond & (t < ts_lit(end) + F.expr("INTERVAL 1 DAY"))
        else:
            cond = cond & (t <= ts_lit(end))
    return df.where(cond)


def within_box(df: DataFrame, box=C.WA_STATION_BOX, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows whose point lies inside the (inclusive) box."""
    la0, la1, lo0, lo1 = box
    return df.where(F.col(lat).between(la0, la1) & F.col(lon).between(lo0, lo1))


def within_box_or_all(df: DataFrame, box=C.WA_GRID_BOX, lat: str = "latitude",
                      lon: str = "longitude") -> DataFrame:
    """Grid box mask whose two axes are applied separably; if either axis has
    no value inside the box, no mask is applied at all.

    The per-axis emptiness test is a scalar subquery (one partial aggregate
    per task, merged into a single subquery by the optimizer).
    """
    la0, la1, lo0, lo1 = box
    in_lat = F.col(lat).between(la0, la1)
    in_lon = F.col(lon).between(lo0, lo1)
    any_lat = df.agg(F.coalesce(F.bool_or(in_lat), F.lit(False))).scalar()
    any_lon = df.agg(F.coalesce(F.bool_or(in_lon), F.lit(False))).scalar()
    return df.where(~(any_lat & any_lon) | (in_lat & in_lon))


def extent(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One-row bounding box of a point table."""
    return df.agg(F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"),
                  F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"))


def filter_by_extent(points: DataFrame, grid: DataFrame, lat: str = "lat", lon: str = "lon",
                     grid_lat: str = "latitude", grid_lon: str = "longitude") -> DataFrame:
    """Points inside the (inclusive) bounding box of another table (scalar subqueries)."""
    lat_min = grid.agg(F.min(grid_lat)).scalar()
    lat_max = grid.agg(F.max(grid_lat)).scalar()
    lon_min = grid.agg(F.min(grid_lon)).scalar()
    lon_max = grid.agg(F.max(grid_lon)).scalar()
    return points.where(F.col(lat).between(lat_min, lat_max) & F.col(lon).between(lon_min, lon_max))


def station_filter(df: DataFrame, station: str, station_col: str = "station") -> DataFrame:
    return df.where(F.col(station_col) == F.lit(station))


def station_exists(df: DataFrame, station: str, station_col: str = "station") -> bool:
    return len(station_filter(df, station, station_col).select(station_col).take(1)) > 0


def exclude_stations(df: DataFrame, names, station_col: str = "station") -> DataFrame:
    """Drop rows of the named stations (a short, fixed list)."""
    return df.where(~F.col(station_col).isin(list(names)))


def null_nonfinite_cols(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: null_nonfinite(c) for c in cols})


def at_hour(df: DataFrame, date, hour: int, time_col: str = "time", by=("station",)) -> DataFrame:
    """Per group, the first row whose timestamp falls on ``date`` at ``hour``."""
    t = F.col(time_col)
    hit = df.where((F.to_date(t) == F.lit(str(date)).cast("date")) & (F.hour(t) == hour))
    others = [c for c in df.columns if c not in by]
    first = F.min_by(F.struct(*others), t).alias("_r")
    return hit.groupBy(*by).agg(first).select(*by, "_r.*")


def day_of(df: DataFrame, marks: DataFrame, time_col: str = "time", by=("station",)) -> DataFrame:
    """Rows on the same calendar day (and group) as any row of ``marks``."""
    days = marks.select(*by, F.to_date(time_col).alias("_day")).distinct()
    return (df.withColumn("_day", F.to_date(time_col))
            .join(days, [*by, "_day"], "left_semi")
            .drop("_day"))


def axis_values(df: DataFrame, axis_col: str) -> Column:
    """The sorted distinct values of an axis as one array, a scalar subquery.

    An axis is short (run times, lead steps, latitudes, longitudes of one grid); the distinct values are collected by
    a partial aggregate per task, so the data itself is never shuffled by them."""
    return df.agg(F.array_sort(F.collect_set(axis_col))).scalar()


def axis_table(df: DataFrame, axis_col: str) -> DataFrame:
    """(idx, axis_col): the distinct values of a short axis in order, from one aggregate row."""
    row = df.agg(F.array_sort(F.collect_set(axis_col)).alias("v"))
    return row.select(F.posexplode("v").alias("idx", axis_col)).withColumn("idx", F.col("idx").cast("long"))


def clamp_index(i: int, n: int) -> int:
    return max(0, min(int(i), n - 1))


def _clamped(i, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(int(i)), n - 1))


def frame_range(df: DataFrame, start: int, end: int, axis_col: str = "time") -> DataFrame:
    """Rows whose axis position lies in [start, end] after clamping (end >= start), with that position attached.

    The bounds and positions come from the axis array, so rows are filtered where they are read."""
    values = axis_values(df, axis_col)
    n = F.size(values)
    lo = _clamped(start, n)
    hi = F.greatest(lo, _clamped(end, n))
    t = F.col(axis_col)
    chosen = df.where(t.between(F.get(values, lo), F.get(values, hi)))
    return chosen.withColumn(f"{axis_col}_idx", (F.array_position(values, t) - 1).cast("long"))


def axis_pick(df: DataFrame, axis_col: str, index: int) -> Column:
    """The axis value at the clamped position (null for an empty table)."""
    values = axis_values(df, axis_col)
    return F.get(values, _clamped(index, F.size(values)))


def slice_field(df: DataFrame, time_index: int, step_index: int,
                time_col: str = "time", step_col: str = "step") -> DataFrame:
    """Rows of the 2-D field at (time_index, step_index), both clamped into range: two equality filters."""
    return df.where((F.col(time_col) == axis_pick(df, time_col, time_index))
                    & (F.col(step_col) == axis_pick(df, step_col, step_index)))
