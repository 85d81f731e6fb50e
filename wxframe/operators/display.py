"""Display-scale numerics: normalisation to 12 colour steps, contour levels, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import col
from . import select as S


def normalize(df: DataFrame, value: str, vmin, vmax, steps: int = C.QUANT_STEPS) -> DataFrame:
    """Adds ``p`` (clamped to [0, 1]), ``level`` (p quantised to ``steps``) and
    ``arrow_size`` (0.5 + 1.5 p).  A null value stays null in every output.

    ``vmin``/``vmax`` are columns (e.g. scalar subqueries of a limits query) or numbers.
    """
    lo = vmin if isinstance(vmin, Column) else F.lit(float(vmin))
    hi = vmax if isinstance(vmax, Column) else F.lit(float(vmax))
    df = df.withColumns({"_lo": lo, "_hi": hi})       # limits evaluated once, then referenced
    lo, hi = F.col("_lo"), F.col("_hi")
    span = F.when((hi - lo) == 0, F.lit(1.0)).otherwise(hi - lo)
    raw = (col(value) - lo) / span
    p = F.when(F.isnan(raw), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    p = F.when(col(value).isNull(), F.lit(None).cast("double")).otherwise(p)
    return df.withColumn("p", p).withColumns({
        "level": F.round(F.col("p") * steps) / float(steps),
        "arrow_size": F.lit(0.5) + F.lit(1.5) * F.col("p"),
    }).drop("_lo", "_hi")


def contour_levels(limits: DataFrame, n: int = C.CONTOUR_LEVELS, lo: str = "vmin", hi: str = "vmax") -> DataFrame:
    """``n`` equally spaced levels from vmin to vmax inclusive (last one exactly vmax)."""
    i = F.col("i")
    step = (F.col(hi) - F.col(lo)) / float(n - 1)
    return (limits.select(lo, hi, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
            .select(i.cast("long").alias("i"),
                    F.when(i == n - 1, F.col(hi)).otherwise(F.col(lo) + step * i).alias("level")))


def clamp_stride(stride, default: int = 2) -> int:
    try:
        s = int(stride)
    except (TypeError, ValueError):
        return default
    return max(C.STRIDE_MIN, min(C.STRIDE_MAX, s))


def thin(df: DataFrame, stride, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Keep every ``stride``-th latitude (storage order: north to south) and
    every ``stride``-th longitude (west to east).

    ``stride='auto'`` uses max(1, n_lat // 30).  Positions come from the two
    axis arrays (scalar subqueries), so the field is only filtered.
    """
    lats, lons = S.axis_values(df, lat), S.axis_values(df, lon)
    n_lat = F.size(lats)
    s = F.greatest(F.lit(1), F.floor(n_lat / C.AUTO_STRIDE_DIVISOR)) if stride == "auto" else F.lit(clamp_stride(stride))
    from_north = n_lat - F.array_position(lats, F.col(lat))
    from_west = F.array_position(lons, F.col(lon)) - 1
    return df.where((from_north % s == 0) & (from_west % s == 0))
