"""Aggregations: scale limits, completeness, resampled means, extents, metadata, axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import null_nonfinite, round6, ts_lit, wind_speed
from ..session import stored
from . import select as S


def scale_limits(df: DataFrame, var: str, start: int, end: int, axis_col: str = "time") -> DataFrame:
    """min/max (non-finite skipped) of a grid scalar over a frame-index range."""
    sel = S.frame_range(df, start, end, axis_col)
    v = null_nonfinite(var)
    return sel.agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"))


def wind_limits(df: DataFrame, u: str, v: str, start: int, end: int, axis_col: str = "time") -> DataFrame:
    """min/max of the wind magnitude over a frame-index range."""
    sel = S.frame_range(df, start, end, axis_col)
    sp = wind_speed(null_nonfinite(u), null_nonfinite(v))
    return sel.agg(F.min(sp).alias("vmin"), F.max(sp).alias("vmax"))


def display_limits(df: DataFrame, variables) -> DataFrame:
    """Viewer limits per display variable as (variable, vmin, vmax) rows.

    ``windXX`` -> [0, max |(uXX, vXX)|], or [0, 200] when a component is
    missing; cloud covers -> [0, 1]; otherwise [min, max] with max + 1 when
    the two are equal.  One aggregation pass computes every limit.
    """
    aggs, specs = [], []
    for i, name in enumerate(variables):
        if name.startswith("wind"):
            sfx = name[4:]
            u, v = f"u{sfx}", f"v{sfx}"
            if u in df.columns and v in df.columns:
                aggs.append(F.max(wind_speed(null_nonfinite(u), null_nonfinite(v))).alias(f"_hi{i}"))
                specs.append((name, F.lit(0.0), F.col(f"_hi{i}")))
            else:
                specs.append((name, F.lit(0.0), F.lit(200.0)))
        elif name in C.CLOUD_VARS:
            specs.append((name, F.lit(0.0), F.lit(1.0)))
        else:
            aggs += [F.min(null_nonfinite(name)).alias(f"_lo{i}"), F.max(null_nonfinite(name)).alias(f"_hi{i}")]
            lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            specs.append((name, lo, F.when(lo == hi, hi + 1.0).otherwise(hi)))
    row = df.agg(*aggs) if aggs else df.limit(1).select(F.lit(1).alias("_one"))
    rows = [F.struct(F.lit(n).alias("variable"), lo.cast("double").alias("vmin"), hi.cast("double").alias("vmax"))
            for n, lo, hi in specs]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def all_limits(obs_long: DataFrame, name: str = "variable", value: str = "value") -> DataFrame:
    """Global min/max per variable of a long table (one grouped aggregate)."""
    v = null_nonfinite(value)
    return obs_long.groupBy(name).agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"))


def completeness(obs_long: DataFrame, variable: str, by: str = "station") -> DataFrame:
    """Non-null observation count of one variable for every station in the table."""
    hit = (F.col("variable") == variable) & null_nonfinite("value").isNotNull()
    return obs_long.groupBy(by).agg(F.count_if(hit).alias("n_valid"))


def resample_mean(obs_long: DataFrame, variable: str, every: str, start, end,
                  by: str = "station", time_col: str = "time") -> DataFrame:
    """Mean per station per calendar bin (``'1 day'`` or ``'1 hour'``) over [start, end],
    every bin of the range present (empty bins are null).

    Bins come from ``explode(sequence(...))`` per station — the output
    grid itself, no join against a global calendar.
    """
    unit = {"1 day": "day", "1 hour": "hour"}[every]
    src = S.time_slice(obs_long.where(F.col("variable") == variable), start, end, time_col)
    binned = (src.groupBy(by, F.date_trunc(unit, time_col).cast("timestamp_ntz").alias("bin"))
              .agg(F.avg(null_nonfinite("value")).alias("mean")))
    lo = F.date_trunc(unit, ts_lit(start)).cast("timestamp_ntz")
    hi_src = ts_lit(end) if not S.is_bare_date(end) else ts_lit(end) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    hi = F.date_trunc(unit, hi_src).cast("timestamp_ntz")
    step = F.expr(f"INTERVAL {every}")
    grid = (src.select(by).distinct()
            .select(by, F.explode(F.sequence(lo, hi, step)).alias("bin")))
    return grid.join(binned, [by, "bin"], "left").select(by, F.col("bin").alias("time"), "mean")


def dataset_metadata(obs_wide: DataFrame, time_col: str = "time") -> DataFrame:
    """One row: lat/lon ranges, time start/end/count (distinct times), station count."""
    return obs_wide.agg(
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.date_format(F.min(time_col), "yyyy-MM-dd'T'HH:mm:ss").alias("time_start"),
        F.date_format(F.max(time_col), "yyyy-MM-dd'T'HH:mm:ss").alias("time_end"),
        F.count_distinct(time_col).alias("time_count"),
        F.count_distinct("station").alias("station_count"),
    )


def series_metadata(obs: DataFrame, stations: DataFrame, time_col: str = "time", by: str = "station") -> DataFrame:
    """:func:`dataset_metadata` of observations of listed stations, without joining coordinates to them: bounds come from
    the stations that report, the count of instants from time bitmaps."""
    bits = stored(time_bitmaps(obs.join(stations.select(by), by, "left_semi"), by, time_col))
    spans = obs.groupBy(by).agg(F.min(time_col).alias("_from"), F.max(time_col).alias("_to"))
    instants = bits.groupBy("bucket", "rest").agg(F.bitmap_or_agg("bits").alias("bits")) \
        .agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).scalar()
    return spans.join(stations.select(by, "lat", "lon"), by).agg(
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.date_format(F.min("_from"), "yyyy-MM-dd'T'HH:mm:ss").alias("time_start"),
        F.date_format(F.max("_to"), "yyyy-MM-dd'T'HH:mm:ss").alias("time_end"),
        F.max(instants).alias("time_count"), F.count_distinct(by).alias("station_count"))


def axes(df: DataFrame, time_col: str = "time", step_col: str = "step") -> DataFrame:
    """(axis, idx, label, value) rows: run times as 'yyyy-MM-dd HH:mm', steps as whole hours."""
    t = S.axis_table(df, time_col).select(
        F.lit("time").alias("axis"), "idx", F.date_format(time_col, "yyyy-MM-dd HH:mm").alias("label"),
        F.lit(None).cast("long").alias("value"))
    s = S.axis_table(df, step_col).select(
        F.lit("step").alias("axis"), "idx", F.col(step_col).cast("long").cast("string").alias("label"),
        F.col(step_col).cast("long").alias("value"))
    return t.unionByName(s)


def date_groups(frames: DataFrame, time_col: str = "valid_time") -> DataFrame:
    """Contiguous runs of frames sharing a calendar date: (label, start_idx, end_idx).

    Frames are the distinct sorted instants; a date's frames are contiguous
    in sorted order, so min/max index per date is the run.
    """
    return (S.axis_table(frames, time_col).groupBy(F.date_format(time_col, "yyyy-MM-dd").alias("label"))
            .agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx")))


def time_bitmaps(df: DataFrame, by: str = "station", time_col: str = "time", unit_seconds: int = 60) -> DataFrame:
    """(by, bucket, rest, bits, points): the instants of each series as bitmaps, one bit per ``unit_seconds``.

    An instant is its number of whole units and the rest below a unit, so any time is exact; a regular axis has one rest.
    Bitmaps merge by OR: distinct instants of any set of series come from this table, a row per series and 32,768 units."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    unit = F.lit(unit_seconds * 1_000_000).cast("long")
    rows = df.select(by, F.floor(micros / unit).cast("long").alias("_i"), F.pmod(micros, unit).alias("rest"))
    return rows.groupBy(by, F.bitmap_bucket_number("_i").alias("bucket"), "rest").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_i")).alias("bits"), F.count(F.lit(1)).alias("points"))


def compare_resolution(a: DataFrame, b: DataFrame, by: str = "station", time_col: str = "time") -> DataFrame:
    """Steps, stations and total points of two datasets and the growth factor b/a.

    Each dataset is evaluated once, into its time bitmaps; the three counts come from that small table."""
    def counted(df, tag):
        bits = stored(time_bitmaps(df, by, time_col))
        steps = bits.groupBy("bucket", "rest").agg(F.bitmap_or_agg("bits").alias("bits")) \
            .agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(f"steps_{tag}"))
        names = bits.select(by).distinct().agg(F.count(by).alias(f"stations_{tag}"))
        points = bits.agg(F.coalesce(F.sum("points"), F.lit(0)).alias(f"points_{tag}"))
        return steps, names, points
    (steps_a, names_a, points_a), (steps_b, names_b, points_b) = counted(a, "a"), counted(b, "b")
    out = points_a.select(steps_a.scalar().alias("steps_a"), names_a.scalar().alias("stations_a"), "points_a",
                          steps_b.scalar().alias("steps_b"), names_b.scalar().alias("stations_b"),
                          points_b.scalar().alias("points_b"))
    return out.withColumn("growth", round6(F.col("points_b") / F.col("points_a")))


def ui_meta(obs_long: DataFrame, by: str = "station", time_col: str = "time", source: str = "stations") -> DataFrame:
    """Sorted station list (one row per station; the sort is a range-partitioned
    distributed sort) with the dataset's [first date, last date], its variables
    (sorted, comma-joined) and the source label as scalar columns."""
    first = obs_long.agg(F.date_format(F.min(time_col), "yyyy-MM-dd")).scalar()
    last = obs_long.agg(F.date_format(F.max(time_col), "yyyy-MM-dd")).scalar()
    names = obs_long.agg(F.array_join(F.array_sort(F.collect_set("variable")), ",")).scalar()
    st = obs_long.select(by).distinct()
    return st.select(by, first.alias("date_min"), last.alias("date_max"), names.alias("variables"),
                     F.lit(source).alias("source")).orderBy(by)
