"""Temperature anomaly detection with a solar explanation, for every station
in one job.

Detectors (15-minute series, row order):
* rolling median: |x - median of the centred 5 rows| (all 5 present),
  flagged above mean + 3 * sample std of the station's deviations;
* slope acceleration: |slope(i) - slope(i-1)| with slope = diff / 0.25 h,
  flagged above mean + 4 * population std of the station's changes;
* diurnal zone: the slope into a row contradicts the expected tendency of
  its time of day (rising 06-12, falling 16-21) with |slope| >= 0.2.
An anomaly is *explained* when the solar value deviates from the median of
its +-4 row neighbourhood by more than 2.5 local sample stds (>= 3 values).

Row-order windows run on position blocks with halos (see ``windows``), and
station thresholds are grouped aggregates joined back, so no station is
ever processed in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import null_nonfinite, temp_zone
from .windows import DEFAULT_BLOCK, block_window, series_positions, with_halo

HALO = max(C.SOLAR_WINDOW, C.ROLLING_WINDOW // 2, 2)


def anomaly_frame(series: DataFrame, value: str = "airTemperature", solar: str | None = "solarExposure",
                  by=("station",), time_col: str = "time", block: int = DEFAULT_BLOCK,
                  compat_nan: bool = False, compat_positions: bool = False) -> DataFrame:
    """Per-row detector columns: ``median_flag``, ``slope_flag``, ``zone_flag``,
    ``anomaly`` and (with ``solar``) ``explained``."""
    by = list(by)
    keep = [*by, time_col, value] + ([solar] if solar else [])
    series = series.select(*keep).withColumns({c: null_nonfinite(c) for c in [value, *([solar] if solar else [])]})
    d = with_halo(series_positions(series, by, time_col), HALO, block)
    w = block_window(by)
    half = C.ROLLING_WINDOW // 2
    w5 = w.rowsBetween(-half, half)
    x = F.col(value)
    cols = {
        "_med": F.when(F.count(x).over(w5) == C.ROLLING_WINDOW, F.percentile(x, 0.5).over(w5)),
        "_prev": F.lag(x).over(w),
        "_next": F.lead(x).over(w),
    }
    if solar:
        ws = w.rowsBetween(-C.SOLAR_WINDOW, C.SOLAR_WINDOW)
        s = F.col(solar)
        cols.update({"_scnt": F.count(s).over(ws), "_smed": F.percentile(s, 0.5).over(ws),
                     "_ssd": F.stddev_samp(s).over(ws)})
    d = d.withColumns(cols).where("_core").drop("_blk", "_core")
    d = d.withColumns({
        "dev": F.abs(x - F.col("_med")),
        "slope_in": (x - F.col("_prev")) / C.DT_HOURS,
        "slope_out": (F.col("_next") - x) / C.DT_HOURS,
        "zone": temp_zone(time_col),
    }).withColumn("change", F.abs(F.col("slope_out") - F.col("slope_in")))

    thr = d.groupBy(*by).agg(
        (F.avg("dev") + C.MEDIAN_Z * F.stddev_samp("dev")).alias("_med_thr"),
        (F.avg("change") + C.SLOPE_Z * F.stddev_pop("change")).alias("_slope_thr"),
        F.count_if(x.isNull()).alias("_nulls"), F.count("dev").alias("_devs"))
    d = d.join(thr, by, "inner")

    if compat_positions:
        # flags land on the row whose position equals the deviation's index
        # among non-null deviations (two rows early, plus one per earlier null)
        nn = series_positions(d.where(F.col("dev").isNotNull()).select(*by, time_col, "dev", "_med_thr"),
                              by, time_col)
        hits = nn.where(F.col("dev") > F.col("_med_thr")).select(*by, "_pos").withColumn("_mhit", F.lit(True))
        d = d.join(hits, [*by, "_pos"], "left").withColumn("median_flag", F.coalesce("_mhit", F.lit(False)))
    else:
        d = d.withColumn("median_flag", F.coalesce(F.col("dev") > F.col("_med_thr"), F.lit(False)))

    slope_ok = F.col("_nulls") == 0 if compat_nan else F.lit(True)
    d = d.withColumn("slope_flag", slope_ok & F.coalesce(F.col("change") > F.col("_slope_thr"), F.lit(False)))

    zone, sl = F.col("zone"), F.col("slope_in")
    active = (zone != 0) & F.col("_prev").isNotNull() if not compat_nan else (zone != 0) & (F.col("_pos") > 0)
    contradicts = (F.abs(sl) >= C.MIN_SLOPE) & (F.signum(sl) != zone)
    if compat_nan:
        contradicts = contradicts | sl.isNull()
    d = d.withColumn("zone_flag", F.coalesce(active & contradicts, F.lit(False)))
    # a series without one whole window of five has no anomalies at all
    d = d.withColumn("anomaly", (F.col("_devs") > 0) & (F.col("median_flag") | F.col("slope_flag") | F.col("zone_flag")))

    if solar:
        s = F.col(solar)
        sd = F.col("_ssd")
        d = d.withColumn("explained", F.coalesce(
            (F.col("_scnt") >= 3) & sd.isNotNull() & (sd != 0) & (F.abs(s - F.col("_smed")) > C.SOLAR_Z * sd),
            F.lit(False)))
    return d.drop("_med", "_prev", "_next", "_scnt", "_smed", "_ssd", "_med_thr", "_slope_thr", "_nulls", "_devs", "_mhit",
                  "_len")


def detect_anomalies(frame: DataFrame, by=("station",), time_col: str = "time") -> DataFrame:
    """Anomalous rows only (union of the three detectors, as one OR)."""
    return frame.where("anomaly")


def classify_solar(frame: DataFrame, mode: str = "all") -> DataFrame:
    """Anomalies with their ``explained`` flag; ``mode='explained'`` keeps
    only the explained ones, ``'unexplained'`` the rest."""
    a = frame.where("anomaly")
    if mode == "explained":
        return a.where("explained")
    if mode == "unexplained":
        return a.where(~F.col("explained"))
    return a
