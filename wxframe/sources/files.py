"""File sources and sinks.

Station observations arrive as one CSV per station in ``YYYYMM/`` month
folders (``.csv`` or ``.csv.gz``; Spark decompresses gzip natively).
Gridded data is Parquet laid out by partition columns, so run-date and
month filters prune whole folders:

* reanalysis: ``base/year=YYYY/month=MM/member={accum,instant,pressure}/``
* forecast runs: ``base/year=YYYY/month=MM/day=DD/member={single,pressure}/``
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import null_nonfinite

STATIONS_SCHEMA = "code STRING, name STRING, lat DOUBLE, lon DOUBLE, alt INT"
GRID_POINTS_SCHEMA = "name STRING, lat DOUBLE, lon DOUBLE"

REANALYSIS_MEMBERS = ["accum", "instant", "pressure"]
FORECAST_MEMBERS = ["single", "pressure"]


class IncompleteMonthError(ValueError):
    pass


_FIELD = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'        # commas outside quotes


def parse_station_files(raw: DataFrame, variables=C.STATION_VARIABLES, time_format: str | None = None) -> DataFrame:
    """Rows of whole station files (``value`` = a file's text), columns found by each file's own header.

    Station files are one month of one station, so a file is a row.  Columns may stand in any order, further columns
    are ignored and missing ones are null; a value that is no finite number is null.  Rows without a parseable
    ``time`` are dropped.  ``_ingest`` = (month, file, position) orders rows as the files were laid down, whatever
    order Spark reads them in.
    """
    clean = lambda c: F.transform(c, lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))
    files = raw.select(F.col("_metadata.file_path").alias("_file"), F.split("value", "\r?\n").alias("_lines"))
    files = files.select(
        "_file", clean(F.split(F.regexp_replace(F.get("_lines", F.lit(0)), "^\ufeff", ""), _FIELD)).alias("_head"),
        F.posexplode(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))).alias("_pos", "_line"))
    files = files.withColumn("_row", clean(F.split("_line", _FIELD)))

    def field(name):
        at = F.array_position("_head", name)
        return F.when(at > 0, F.get("_row", (at - 1).cast("int")))

    month = F.regexp_extract("_file", r"/(\d{6})/[^/]+$", 1)
    time = F.try_to_timestamp(field("time"), F.lit(time_format)) if time_format else field("time").try_cast("timestamp_ntz")
    return files.select(
        time.cast("timestamp_ntz").alias("time"), *[null_nonfinite(field(v).try_cast("double")).alias(v) for v in variables],
        F.regexp_extract("_file", r"([^/]+?)(\.csv)?(\.gz)?$", 1).alias("station"), month.alias("month"),
        F.struct(month.alias("month"), F.col("_file").alias("file"), F.col("_pos").alias("pos")).alias("_ingest"),
    ).where(F.col("time").isNotNull())


def station_glob(root: str, year: int | str | None = None) -> str:
    return f"{root.rstrip('/')}/{year if year is not None else '[0-9][0-9][0-9][0-9]'}[0-1][0-9]/*.csv*"


def read_station_csv(spark: SparkSession, root: str, year: int | str | None = None,
                     variables=C.STATION_VARIABLES, time_format: str | None = None) -> DataFrame:
    """All station files of a year (or every year): station = file stem, month = folder name, ``time`` as a naive UTC
    timestamp, one column per variable (see :func:`parse_station_files`)."""
    raw = spark.read.text(station_glob(root, year), wholetext=True)
    return parse_station_files(raw, variables, time_format)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station list ``code,name,lat,lon,alt``; ``station`` = name."""
    df = spark.read.option("header", True).schema(STATIONS_SCHEMA).csv(path)
    return df.withColumn("station", F.col("name"))


def read_grid_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(GRID_POINTS_SCHEMA).csv(path)


def _code(names):
    """The partition columns (year, month[, day]) as one number, so a filter on it prunes folders."""
    out = F.lit(0)
    for n in names:
        out = out * 100 + F.col(n).cast("int")
    return out


def member_catalog(spark: SparkSession, base: str) -> DataFrame:
    """One row per data file under ``base`` with the partition columns of its folder (year, month[, day], member).

    The files are listed, not opened: the reader is asked for the values in the folder names only."""
    listed = spark.read.format("binaryFile").option("basePath", base).load(base)
    return listed.drop("path", "modificationTime", "length", "content")


def complete_units(catalog: DataFrame, names, members, strict: bool) -> list[int]:
    """Codes of the months or runs that have every member, from folder names alone.

    One number per month or run comes to the driver (as file listing has them already); an incomplete one raises
    with ``strict`` and is left out otherwise."""
    have = catalog.where(F.col("member").isin(list(members))).groupBy(_code(names).alias("unit")) \
        .agg(F.count_distinct("member").alias("n")).collect()
    bad = sorted(r.unit for r in have if r.n < len(members))
    if strict and bad:
        raise IncompleteMonthError(f"{len(bad)} without all of {', '.join(members)}: {bad}")
    return sorted(r.unit for r in have if r.n == len(members))


def _members(spark: SparkSession, base: str, names, members, strict: bool) -> dict[str, DataFrame]:
    units = complete_units(member_catalog(spark, base), names, members, strict)
    out = {}
    for m in members:
        glob = f"{base.rstrip('/')}/{'/'.join(['*'] * len(names))}/member={m}"
        out[m] = spark.read.option("basePath", base).parquet(glob).where(_code(names).isin(units)).drop("member")
    return out


def read_reanalysis(spark: SparkSession, base: str, strict: bool = True) -> dict[str, DataFrame]:
    """The three reanalysis members (accum, instant, pressure) of complete months.

    A month lacking a member raises with ``strict`` (the month cannot be
    built), otherwise it is skipped.  Completeness is a filter on partition
    columns: no row is shuffled for it, and only complete folders are read.
    """
    return _members(spark, base, ["year", "month"], REANALYSIS_MEMBERS, strict)


def read_forecast(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Forecast members (single, pressure) of the runs that have both; incomplete runs are skipped."""
    return _members(spark, base, ["year", "month", "day"], FORECAST_MEMBERS, strict=False)


def run_date(year: str = "year", month: str = "month", day: str = "day"):
    return F.make_date(F.col(year).cast("int"), F.col(month).cast("int"), F.col(day).cast("int"))


def available_run_dates(df: DataFrame) -> DataFrame:
    """Distinct run dates (``yyyy-MM-dd``) of a run-partitioned table."""
    return df.select(F.date_format(run_date(), "yyyy-MM-dd").alias("run_date")).distinct()


def load_date_range_files(df: DataFrame, start, end, time_col: str = "time",
                          span_days: int = C.RUN_FILE_SPAN_DAYS) -> DataFrame:
    """Runs that may cover [start, end] (run date <= end, run date + span >= start),
    then the inclusive time slice.  The run-date predicate only references
    partition columns, so it prunes folders before any file is opened."""
    from ..operators.select import time_slice
    d0 = _dt.date.fromisoformat(str(start)[:10])
    d1 = _dt.date.fromisoformat(str(end)[:10])
    rd = run_date()
    pruned = df.where((rd <= F.lit(d1)) & (rd >= F.lit(d0 - _dt.timedelta(days=span_days))))
    return time_slice(pruned, start, end, time_col)


# --------------------------------------------------------------------------- sinks

def _write(df: DataFrame, path: str, by, mode: str, compression: str = "zstd", sort=()) -> None:
    """Partitioned Parquet: rows are rebalanced on the partition columns (adaptive execution splits a large month),
    so a folder gets a few files and not one per task; only the partitions present are overwritten."""
    out = df.hint("rebalance", *[F.col(c) for c in by])
    out = out.sortWithinPartitions(*by, *sort) if sort else out
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", compression) \
        .partitionBy(*by).parquet(path)


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """The dataset at ``path``; None if nothing is there yet. Any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_monthly(df: DataFrame, path: str, time_col: str = "valid_time", mode: str = "overwrite",
                  compression: str = "zstd", skip_existing: bool = False) -> None:
    """Partition by year/month of ``time_col``; overwrite replaces only the
    months present in ``df`` (dynamic partition overwrite).  With
    ``skip_existing`` months already in ``path`` are left untouched."""
    out = df.withColumns({"year": F.year(time_col), "month": F.month(time_col)})
    if skip_existing and (have := _written(df.sparkSession, path)) is not None:
        out = out.join(have.select("year", "month").distinct(), ["year", "month"], "left_anti")
    _write(out, path, ["year", "month"], mode, compression)


def write_runs(df: DataFrame, path: str, time_col: str = "time", mode: str = "overwrite",
               compression: str = "zstd") -> None:
    """One folder per forecast run (year/month/day of the run time)."""
    out = df.withColumns({"year": F.year(time_col), "month": F.month(time_col), "day": F.dayofmonth(time_col)})
    _write(out, path, ["year", "month", "day"], mode, compression)


def write_manifest(runs: DataFrame, path: str, file_date: str = "file_date", time_col: str = "time") -> None:
    """The times of each run file of ``runs``, kept in ``path/_manifest`` (readers of ``path`` skip it).  Only the run
    files present are replaced, so it is kept up to date run by run."""
    times = runs.select(F.col(time_col).alias("time"), F.col(file_date).cast("date").alias("file_date")).distinct()
    _write(times, f"{path.rstrip('/')}/_manifest", ["file_date"], "overwrite")


def read_manifest(spark: SparkSession, path: str, file_date: str = "file_date", time_col: str = "time") -> DataFrame:
    """(time, file_date): the earliest run file of each time, from the manifest beside the runs."""
    kept = spark.read.parquet(f"{path.rstrip('/')}/_manifest")
    return kept.groupBy(F.col("time").alias(time_col)).agg(F.min("file_date").alias(file_date))


def write_units(spark: SparkSession, units: dict[str, str], path: str) -> None:
    """(variable, unit) of converted variables, kept in ``path/_units`` (readers of ``path`` skip it)."""
    spark.createDataFrame(sorted(units.items()), "variable string, unit string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path.rstrip('/')}/_units")


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/_units")


def write_obs(df: DataFrame, path: str, time_col: str = "time", mode: str = "overwrite") -> None:
    """Combined station dataset, partitioned by year, sorted by station/time within files."""
    _write(df.withColumn("year", F.year(time_col)), path, ["year"], mode, sort=("station", time_col))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
