"""Weather-shaped views derived from the shared test tables.

The test tables are star-schema style (customer, events, lineitem); these
functions reshape them into the station / observation / forecast tables the
operators expect.  Each is a lazy DataFrame over the parquet scan, so
projection and filters of the query that uses it reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _plus_days(n: Column) -> Column:
    return F.expr(EPOCH_NTZ) + F.make_dt_interval(days=n.cast("int"))


def v_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, code, lat, lon, alt — one row per customer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("S"), k.cast("string")).alias("station"),
        F.col("c_name").alias("code"),
        (F.lit(-36.0) + ((k * 37) % 260).cast("double") / 10.0).alias("lat"),
        (F.lit(110.0) + ((k * 53) % 250).cast("double") / 10.0).alias("lon"),
        (k % 500).cast("int").alias("alt"),
    )


def _variable_of(event_type: Column) -> Column:
    return (F.when(event_type == "click", "airTemperature")
            .when(event_type == "view", "dewPoint")
            .when(event_type == "purchase", "rainfall")
            .when(event_type == "signup", "solarExposure")
            .otherwise("wind_3m_speed"))


def v_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations: station, time, variable, value, event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station"),
        F.col("ts").alias("time"),
        _variable_of(F.col("event_type")).alias("variable"),
        F.col("value"),
        F.col("event_id"),
    )


def v_series15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 15-minute series per station with planted solar nulls.

    Positions are the row number per (group, event type) in (ts, event_id)
    order.  With only five groups a plain row_number window would run in
    five tasks, so positions come from per-minute counts and a prefix sum
    (``operators.windows.series_positions``) instead: events are dense, so
    the chunk is a minute, keeping every ranked chunk small.
    """
    from ..operators.windows import series_positions
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "signup"))
    e = e.select((F.col("user_id") % 5).alias("g"), "event_type", "value", "ts", "event_id")
    e = series_positions(e, ["g", "event_type"], "ts", chunk="minute", tie_col="event_id") \
        .withColumn("n", F.col("_pos") + 1)
    # click and signup rows with the same position form one series row (rows exist where a click exists)
    is_click, is_signup = F.col("event_type") == "click", F.col("event_type") == "signup"
    j = (e.groupBy("g", "n")
         .agg(F.max(F.when(is_click, F.col("value"))).alias("t_value"),
              F.max(F.when(is_signup, F.col("value"))).alias("s_value"),
              F.max(is_click.cast("int")).alias("_has_click"))
         .where(F.col("_has_click") == 1))
    return j.select(
        F.concat(F.lit("S"), F.col("g").cast("string")).alias("station"),
        (F.expr(EPOCH_NTZ) + F.make_dt_interval(mins=(F.col("n") - 1).cast("int") * 15)).alias("time"),
        F.col("t_value").alias("airTemperature"),
        F.when(F.col("n") % 17 == 0, None).otherwise(F.col("s_value")).alias("solarExposure"),
    )


def v_era5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly reanalysis cells (five cells, with gaps)."""
    e = table(spark, sf_dir, "events")
    h = (e.groupBy((F.col("user_id") % 5).alias("c"),
                   F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("valid_time"))
         .agg(F.max("value").alias("v"), F.min("value").alias("w")))
    c = F.col("c").cast("double")
    return h.select(
        "valid_time",
        (F.lit(-26.0) - 0.25 * c).alias("latitude"),
        (F.lit(113.0) + 0.25 * c).alias("longitude"),
        (F.lit(273.15) + F.col("v") / 10.0).alias("t2m"),
        (F.col("v") / 10.0 - 5.0).alias("u10"),
        (F.col("w") / 10.0 - 5.0).alias("v10"),
        (F.col("w") / 100000.0).alias("tp"),
        F.least(F.col("v") / 200.0, F.lit(1.0)).alias("tcc"),
    )


def _fc_keys() -> list[Column]:
    return [
        _plus_days(F.col("l_orderkey") % 60).alias("time"),
        (F.col("l_linenumber") * 3).cast("double").alias("step"),
    ]


def v_fc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-level forecast: time, step, latitude, longitude, t2m, msl, u10, v10, tp.
    t2m carries the 9999 missing-value sentinel in some cells."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(
        *_fc_keys(),
        (F.lit(-26.0) - 0.25 * (F.col("l_partkey") % 4).cast("double")).alias("latitude"),
        (F.lit(113.0) + 0.25 * (F.col("l_suppkey") % 5).cast("double")).alias("longitude"),
    ).agg(
        F.max("l_quantity").alias("qmax"), F.min("l_quantity").alias("qmin"),
        F.min("l_extendedprice").alias("pmin"), F.max("l_tax").alias("tp"),
    )
    return g.select(
        "time", "step", "latitude", "longitude",
        F.when(F.col("qmax") == 50, 9999.0).otherwise(F.lit(273.15) + F.col("qmax")).alias("t2m"),
        (F.lit(100000.0) + F.col("pmin") / 10.0).alias("msl"),
        (F.col("qmax") - 25.0).alias("u10"),
        (F.lit(25.0) - F.col("qmin")).alias("v10"),
        "tp",
    )


def v_fc_pl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure-level forecast in tall form: time, step, level, latitude, longitude, t, u, v."""
    li = table(spark, sf_dir, "lineitem")
    m = (F.col("l_partkey") + F.col("l_suppkey")) % 4
    level = F.when(m == 0, 250).when(m == 1, 500).when(m == 2, 850).otherwise(1000)
    g = li.groupBy(
        *_fc_keys(),
        level.alias("level"),
        (F.lit(-26.0) - 0.25 * (F.col("l_partkey") % 3).cast("double")).alias("latitude"),
        (F.lit(113.0) + 0.25 * (F.col("l_suppkey") % 5).cast("double")).alias("longitude"),
    ).agg(F.max("l_quantity").alias("qmax"), F.min("l_quantity").alias("qmin"))
    return g.select(
        "time", "step", "level", "latitude", "longitude",
        (F.lit(273.15) + F.col("qmax")).alias("t"),
        (F.col("qmax") - 25.0).alias("u"),
        (F.lit(25.0) - F.col("qmin")).alias("v"),
    )


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly run files that overlap: file_date, time, step, latitude, longitude, t2m.

    Each forecast row belongs to the file of its week; the first three days
    of a week also appear (t2m + 1) in the previous week's file.  Both copies
    come from one pass: an array of up to two file entries per row, exploded.
    """
    doy0 = F.dayofyear("time") - 1
    d = doy0 - doy0 % 7
    base = F.to_date(F.lit("2024-01-01"))
    f = v_fc(spark, sf_dir)
    copies = F.array(
        F.struct(F.date_add(base, d.cast("int")).alias("file_date"), F.col("t2m").alias("t2m")),
        F.when((d >= 7) & (doy0 % 7 < 3),
               F.struct(F.date_add(base, (d - 7).cast("int")).alias("file_date"), (F.col("t2m") + 1.0).alias("t2m"))),
    )
    return (f.select("time", "step", "latitude", "longitude",
                     F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("_c"))
            .select("_c.file_date", "time", "step", "latitude", "longitude", "_c.t2m"))


VIEWS = {
    "v_stations": v_stations,
    "v_obs": v_obs,
    "v_series15": v_series15,
    "v_era5": v_era5,
    "v_fc": v_fc,
    "v_fc_pl": v_fc_pl,
    "v_runs": v_runs,
}
