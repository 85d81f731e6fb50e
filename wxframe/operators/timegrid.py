"""Time-axis operators: de-duplication, zone shift, regular grids and
1-hour -> 15-minute interpolation (label fill, uniform spread, linear, PCHIP).

Interpolation works per series (``by`` keys, e.g. grid cell and month) with
window functions over the *knots* only, then expands every knot interval
into its fine instants with ``explode(sequence(...))`` — no join between the
fine grid and the knots, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import epoch_seconds, null_nonfinite


def dedupe_time(df: DataFrame, keys, time_col: str = "time", order_col: str = "event_id") -> DataFrame:
    """Keep, per (keys, time), the first row in ``order_col`` order.

    A min_by aggregate combines map-side, so a station with a huge number of
    duplicates never lands whole in one task (unlike a row_number window).
    """
    keys = [*keys, time_col]
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order_col)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def shift_time(df: DataFrame, time_col: str = "time", source_tz: str = C.SOURCE_TZ,
               target_tz: str = C.STATION_TZ, hours: float = C.DEFAULT_SHIFT_HOURS,
               output: str = "utc", out_col: str | None = None) -> DataFrame:
    """Parse naive ``time`` in ``source_tz``, view it in ``target_tz`` and add ``hours``.

    ``output='utc'``: UTC wall clock of the shifted instant (what dropping the
    zone after a conversion yields); ``output='wall'``: wall clock in
    ``target_tz``.  The result stays TIMESTAMP_NTZ.
    """
    t = F.col(time_col)
    if output == "wall":
        base = F.convert_timezone(F.lit(source_tz), F.lit(target_tz), t)
    elif output == "utc":
        base = F.convert_timezone(F.lit(source_tz), F.lit("UTC"), t)
    else:
        raise ValueError(output)
    shifted = base + F.make_dt_interval(secs=F.lit(float(hours) * 3600.0).cast("decimal(18,6)"))
    return df.withColumn(out_col or time_col, shifted)


# ---------------------------------------------------------------------------
# regular grids and 1-hour -> 15-minute interpolation
# ---------------------------------------------------------------------------

def time_grid(df: DataFrame, by, time_col: str = "time", step_minutes: int = 15,
              tail_minutes: int = 45) -> DataFrame:
    """Regular grid per series: first label .. last label + tail, every step.

    One aggregate per series, then ``explode(sequence)``: the grid is
    generated where it is needed, never joined.
    """
    by = list(by)
    span = df.groupBy(*by).agg(F.min(time_col).alias("_t0"), F.max(time_col).alias("_t1"))
    end = F.col("_t1") + F.make_dt_interval(mins=F.lit(int(tail_minutes)))
    return span.select(*by, F.explode(F.sequence(F.col("_t0"), end, F.make_dt_interval(mins=F.lit(int(step_minutes)))))
                       .alias(time_col))


def with_next_buffer(df: DataFrame, period_col: str, time_col: str = "time") -> DataFrame:
    """Append, to every period, the rows at the first instant of the next
    period present (relabelled to this period, ``_buffer`` = true), so the
    last hour of a period can interpolate towards the next one.

    The period table (one row per period) is ranked on its own; the data is
    matched to it by an equi-join on (period, first instant).
    """
    periods = df.groupBy(period_col).agg(F.min(time_col).alias("_first"))
    nxt = periods.select(F.col(period_col).alias("_p"), "_first",
                         F.lag(period_col).over(Window.orderBy(period_col)).alias("_prev"))
    buf = (df.join(nxt, (df[period_col] == nxt["_p"]) & (df[time_col] == nxt["_first"]), "inner")
           .where(F.col("_prev").isNotNull())
           .withColumn(period_col, F.col("_prev"))
           .drop("_p", "_first", "_prev")
           .withColumn("_buffer", F.lit(True)))
    return df.withColumn("_buffer", F.lit(False)).unionByName(buf)


def _sign(c: Column) -> Column:
    return F.signum(c)


def _edge_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """One-sided three-point end derivative, shape preserving."""
    d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (F.when(_sign(d) != _sign(m0), F.lit(0.0))
            .when((_sign(m0) != _sign(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0)
            .otherwise(d))


def _interior_slope(hm1: Column, h: Column, mm1: Column, m: Column) -> Column:
    """Weighted harmonic mean of neighbouring secants (0 at extrema / flats)."""
    w1 = 2 * h + hm1
    w2 = h + 2 * hm1
    flat = (_sign(mm1) != _sign(m)) | (mm1 == 0) | (m == 0)
    return F.when(flat, F.lit(0.0)).otherwise(1.0 / ((w1 / mm1 + w2 / m) / (w1 + w2)))


def _hermite(xa: Column, ya: Column, da: Column, db: Column, h: Column, m: Column, t: Column) -> Column:
    """Cubic Hermite segment in power form: ya + da dt + c1 dt^2 + c0 dt^3."""
    tt = (da + db - 2 * m) / h
    c0 = tt / h
    c1 = (m - da) / h - tt
    dt = t - xa
    dt2 = dt * dt
    return ya + da * dt + c1 * dt2 + c0 * (dt2 * dt)


def interpolate_grid(df: DataFrame, by, time_col: str = "time", period_col: str | None = None,
                     pchip=(), linear=(), spread=(), ffill=(), step_minutes: int = 15,
                     tail_minutes: int = 45, spread_parts: int = 4, buffer: bool = True,
                     extrapolate: bool = True) -> DataFrame:
    """Refine each series (``by`` + ``period_col``) onto a regular grid from
    its first label to its last label + ``tail_minutes``.

    * ``ffill``: value of the latest label at or before the instant (a null
      label stays null);
    * ``spread``: label value / ``spread_parts``, then as ffill (totals kept);
    * ``linear``: straight line between the bracketing labels; null when
      either is null and beyond the last label (unless a next-period buffer
      row continues the series);
    * ``pchip``: monotone piecewise cubic (Fritsch-Carlson slopes with
      one-sided three-point ends; two knots -> straight line), past the last
      knot the last segment is extended.  A series whose variable holds a
      null knot yields null for that variable.

    With ``period_col`` and ``buffer`` the first instant of the next period
    is appended to each period first (see :func:`with_next_buffer`).
    All per-knot quantities are window expressions over one partitioning
    (series) and one ordering (time); each label row then expands into the
    grid instants up to the next label with ``explode(sequence)``.
    """
    by = list(by)
    part = by + ([period_col] if period_col else [])
    pchip, linear, spread, ffill = list(pchip), list(linear), list(spread), list(ffill)
    df = df.withColumns({v: null_nonfinite(v) for v in dict.fromkeys(pchip + linear + spread)})
    lab = with_next_buffer(df, period_col, time_col) if (period_col and buffer) else df.withColumn("_buffer", F.lit(False))
    W = Window.partitionBy(*part).orderBy("_x")
    Wall = Window.partitionBy(*part)
    step = 60.0 * step_minutes
    nb = ~F.col("_buffer")

    lab = lab.withColumn("_x", epoch_seconds(time_col))
    s1 = {
        "_t0": F.min(F.when(nb, F.col("_x"))).over(Wall),
        "_t0ts": F.min(F.when(nb, F.col(time_col))).over(Wall),
        "_tend": F.max(F.when(nb, F.col("_x"))).over(Wall) + 60.0 * tail_minutes,
        "_x1": F.lead("_x").over(W),
        "_xm1": F.lag("_x").over(W),
        "_k": F.row_number().over(W),
        "_n": F.count(F.lit(1)).over(Wall),
    }
    for v in linear:
        s1[f"_l1_{v}"] = F.lead(v).over(W)
        s1[f"_lm1_{v}"] = F.lag(v).over(W)
    for v in pchip:
        s1[f"_y1_{v}"] = F.lead(v).over(W)
        s1[f"_ym1_{v}"] = F.lag(v).over(W)
        s1[f"_nn_{v}"] = F.count_if(F.col(v).isNull()).over(Wall)
    lab = lab.withColumns(s1)

    if pchip:
        lab = lab.withColumn("_h", F.col("_x1") - F.col("_x"))
        lab = lab.withColumns({f"_m_{v}": (F.col(f"_y1_{v}") - F.col(v)) / F.col("_h") for v in pchip})
        s3 = {"_hm1": F.lag("_h").over(W), "_hm2": F.lag("_h", 2).over(W), "_hp1": F.lead("_h").over(W)}
        for v in pchip:
            s3[f"_mm1_{v}"] = F.lag(f"_m_{v}").over(W)
            s3[f"_mm2_{v}"] = F.lag(f"_m_{v}", 2).over(W)
            s3[f"_mp1_{v}"] = F.lead(f"_m_{v}").over(W)
        lab = lab.withColumns(s3)
        k, n = F.col("_k"), F.col("_n")
        dcols = {}
        for v in pchip:
            m, mm1, mm2, mp1 = (F.col(f"_m_{v}"), F.col(f"_mm1_{v}"), F.col(f"_mm2_{v}"), F.col(f"_mp1_{v}"))
            h, hm1, hm2, hp1 = F.col("_h"), F.col("_hm1"), F.col("_hm2"), F.col("_hp1")
            dcols[f"_d_{v}"] = (F.when(n < 2, F.lit(None).cast("double"))
                                .when((n == 2) & (k == 1), m)
                                .when(n == 2, mm1)
                                .when(k == 1, _edge_slope(h, hp1, m, mp1))
                                .when(k == n, _edge_slope(hm1, hm2, mm1, mm2))
                                .otherwise(_interior_slope(hm1, h, mm1, m)))
        lab = lab.withColumns(dcols)
        lab = lab.withColumns({**{f"_d1_{v}": F.lead(f"_d_{v}").over(W) for v in pchip},
                               **{f"_dm1_{v}": F.lag(f"_d_{v}").over(W) for v in pchip}})

    # expand every (non-buffer) label into the grid instants it owns
    t0, tend = F.col("_t0"), F.col("_tend")
    last_i = F.floor((tend - t0) / step)
    lo = F.when(F.col("_k") == 1, F.lit(0)).otherwise(F.ceil((F.col("_x") - t0) / step))
    hi = F.least(F.coalesce(F.ceil((F.col("_x1") - t0) / step) - 1, last_i), last_i)
    lab = lab.where(nb).withColumn("_i", F.explode(F.sequence(lo.cast("long"), F.greatest(lo, hi).cast("long"))))
    lab = lab.where(F.col("_i") <= hi)
    t = t0 + F.col("_i") * step
    at_knot = t == F.col("_x")

    out = {}
    for v in ffill:
        out[v] = F.col(v)
    for v in spread:
        out[v] = F.col(v) / float(spread_parts)
    for v in linear:
        y, y1, ym1 = F.col(v), F.col(f"_l1_{v}"), F.col(f"_lm1_{v}")
        x, x1, xm1 = F.col("_x"), F.col("_x1"), F.col("_xm1")
        from_prev = ((y - ym1) / (x - xm1)) * (t - xm1) + ym1
        from_here = ((y1 - y) / (x1 - x)) * (t - x) + y
        out[v] = (F.when(at_knot & (F.col("_k") > 1), from_prev)
                  .when(x1.isNull() & ~at_knot, F.lit(None).cast("double"))
                  .otherwise(from_here))
    for v in pchip:
        y = F.col(v)
        here = _hermite(F.col("_x"), y, F.col(f"_d_{v}"), F.col(f"_d1_{v}"), F.col("_h"), F.col(f"_m_{v}"), t)
        prev = _hermite(F.col("_xm1"), F.col(f"_ym1_{v}"), F.col(f"_dm1_{v}"), F.col(f"_d_{v}"),
                        F.col("_hm1"), F.col(f"_mm1_{v}"), t)
        beyond = F.col("_x1").isNull() & ~at_knot
        val = (F.when((F.col(f"_nn_{v}") > 0) | (F.col("_n") < 2), F.lit(None).cast("double"))
               .when(at_knot, y)
               .when(beyond, prev if extrapolate else F.lit(None).cast("double"))
               .otherwise(here))
        out[v] = val
    fine_t = F.col("_t0ts") + F.make_dt_interval(secs=(F.col("_i") * step).cast("decimal(18,6)"))
    return lab.select(*part, fine_t.alias(time_col), *[out[v].alias(v) for v in ffill + spread + linear + pchip])


def densify_pchip(long: DataFrame, by, step_minutes: int = 5, time_col: str = "time",
                  value: str = "value", block: int | None = None) -> DataFrame:
    """Refine irregular series onto a finer grid by PCHIP.

    Per series (``by``, e.g. station and variable): nulls are dropped, the
    grid runs from the first to the last sample floored to the step, only
    samples exactly on the grid are kept as knots, grid instants before the
    first knot stay null and the curve is extended after the last one.

    Long series are not sent to one task: knots get their exact position in
    the series and are processed in position blocks with a 3-knot halo (every
    slope and segment reaches at most three knots either way), so a station
    holding most of the data still spreads over many tasks.
    """
    from .windows import DEFAULT_BLOCK, series_positions, with_halo
    by = list(by)
    step_s = 60.0 * step_minutes
    s = long.withColumn(value, null_nonfinite(value)).where(F.col(value).isNotNull())
    # samples of one instant are one knot (their smallest value)
    s = s.groupBy(*by, time_col).agg(F.min(value).alias(value)).withColumn("_x", epoch_seconds(time_col))
    on_grid = F.col("_x") == F.floor(F.col("_x") / step_s) * step_s
    # one aggregate per series: grid bounds over all samples, knot count over on-grid samples
    per_series = s.groupBy(*by).agg((F.floor(F.min("_x") / step_s) * step_s).alias("_g0"),
                                    (F.floor(F.max("_x") / step_s) * step_s).alias("_g1"),
                                    F.count_if(on_grid).alias("_n"))
    knots = s.where(on_grid).select(*by, time_col, value, "_x")
    k = series_positions(knots, by, time_col).join(per_series, by, "inner")
    k = with_halo(k, 3, block or DEFAULT_BLOCK)
    return _pchip_knots(k, by + ["_blk"], time_col, value, step_s, by)


def _pchip_knots(knots: DataFrame, part, time_col: str, value: str, step_s: float, out_by) -> DataFrame:
    W = Window.partitionBy(*part).orderBy("_pos")
    k = knots.withColumns({"_x1": F.lead("_x").over(W), "_xm1": F.lag("_x").over(W),
                           "_y1": F.lead(value).over(W), "_ym1": F.lag(value).over(W),
                           "_k": F.col("_pos") + 1})
    k = k.withColumn("_h", F.col("_x1") - F.col("_x"))
    k = k.withColumn("_m", (F.col("_y1") - F.col(value)) / F.col("_h"))
    k = k.withColumns({"_hm1": F.lag("_h").over(W), "_hm2": F.lag("_h", 2).over(W), "_hp1": F.lead("_h").over(W),
                       "_mm1": F.lag("_m").over(W), "_mm2": F.lag("_m", 2).over(W), "_mp1": F.lead("_m").over(W)})
    kk, n = F.col("_k"), F.col("_n")
    h, hm1, hm2, hp1 = F.col("_h"), F.col("_hm1"), F.col("_hm2"), F.col("_hp1")
    m, mm1, mm2, mp1 = F.col("_m"), F.col("_mm1"), F.col("_mm2"), F.col("_mp1")
    d = (F.when(n < 2, F.lit(None).cast("double"))
         .when((n == 2) & (kk == 1), m).when(n == 2, mm1)
         .when(kk == 1, _edge_slope(h, hp1, m, mp1))
         .when(kk == n, _edge_slope(hm1, hm2, mm1, mm2))
         .otherwise(_interior_slope(hm1, h, mm1, m)))
    k = k.withColumn("_d", d)
    k = k.withColumns({"_d1": F.lead("_d").over(W), "_dm1": F.lag("_d").over(W)})
    k = k.where("_core")
    g0, g1 = F.col("_g0"), F.col("_g1")
    # leading grid instants (before the first knot) belong to the first knot, value null
    lo = F.when(kk == 1, F.lit(0)).otherwise(F.round((F.col("_x") - g0) / step_s))
    last_i = F.round((g1 - g0) / step_s)
    hi = F.least(F.coalesce(F.round((F.col("_x1") - g0) / step_s) - 1, last_i), last_i)
    k = k.withColumn("_i", F.explode(F.sequence(lo.cast("long"), F.greatest(lo, hi).cast("long"))))
    k = k.where(F.col("_i") <= hi)
    t = g0 + F.col("_i") * step_s
    at_knot = t == F.col("_x")
    here = _hermite(F.col("_x"), F.col(value), F.col("_d"), F.col("_d1"), h, m, t)
    prev = _hermite(F.col("_xm1"), F.col("_ym1"), F.col("_dm1"), F.col("_d"), hm1, mm1, t)
    val = (F.when(at_knot, F.col(value))
           .when(t < F.col("_x"), F.lit(None).cast("double"))
           .when(n < 2, F.lit(None).cast("double"))
           .when(F.col("_x1").isNull(), prev)
           .otherwise(here))
    fine_t = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=t.cast("decimal(18,6)"))
    return k.select(*out_by, fine_t.alias(time_col), val.alias(value))
