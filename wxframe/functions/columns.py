"""Column-expression building blocks (all JVM-side, codegen friendly)."""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a string, date or datetime."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def is_bare_date(value) -> bool:
    if isinstance(value, _dt.datetime):
        return False
    if isinstance(value, _dt.date):
        return True
    return len(str(value).strip()) <= 10


def round6(c) -> Column:
    """Round to 1e-6 as round(x * 1e6) / 1e6 (the scaled product is rounded
    half away from zero, which SQL engines agree on; rounding the decimal
    string form instead differs on exact binary ties)."""
    return F.round(col(c) * 1e6) / 1e6


def null_nonfinite(c) -> Column:
    """NaN and +-Inf become NULL, so every later aggregate skips them."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def is_missing_value(c, mv: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """True where ``c`` is close to the declared missing value (numpy isclose rule)."""
    return F.abs(col(c) - F.lit(float(mv))) <= F.lit(atol + rtol * abs(float(mv)))


def wind_speed(u, v) -> Column:
    return F.hypot(col(u), col(v))


def wind_angle(u, v) -> Column:
    """Direction the wind blows *to*, degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(col(u), col(v))) + 360.0, F.lit(360.0))


def flip_angle(a) -> Column:
    """Station 'from' direction -> 'to' direction."""
    return F.pmod(col(a) + 180.0, F.lit(360.0))


def hour_fraction(t) -> Column:
    return F.hour(col(t)) + F.minute(col(t)) / 60.0


def temp_zone(t) -> Column:
    """Expected temperature tendency by time of day: +1 rising, -1 falling, 0 none."""
    h = hour_fraction(t)
    r0, r1 = C.RISING_HOURS
    f0, f1 = C.FALLING_HOURS
    return (F.when((h >= r0) & (h < r1), F.lit(1))
            .when((h >= f0) & (h < f1), F.lit(-1))
            .otherwise(F.lit(0)))


def step_hours_from_ns(c) -> Column:
    """Lead time stored as nanoseconds -> float hours."""
    return col(c).cast("double") / 3600e9


def step_hours_from_interval(c) -> Column:
    """Lead time stored as a day-time interval -> float hours."""
    return F.unix_micros(F.lit(0).cast("timestamp") + col(c)).cast("double") / 3.6e9


def epoch_seconds(t) -> Column:
    """Seconds since 1970 for a TIMESTAMP_NTZ column, as double (exact to microseconds)."""
    return F.unix_micros(col(t).cast("timestamp")).cast("double") / 1e6


def add_hours(t, hours) -> Column:
    """t + whole/fractional hours, keeping TIMESTAMP_NTZ."""
    secs = col(hours).cast("double") * 3600.0 if not isinstance(hours, (int, float)) else F.lit(float(hours) * 3600.0)
    return col(t) + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


# --- Albers equal-area conic (Snyder 1987, ellipsoidal form) ---

def _albers_constants():
    a = C.ALBERS["a"]
    f = 1.0 / C.ALBERS["inv_f"]
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q(phi):
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * math.log((1 - e * s) / (1 + e * s)))

    def m(phi):
        s = math.sin(phi)
        return math.cos(phi) / math.sqrt(1 - e2 * s * s)

    p0, p1, p2 = (math.radians(C.ALBERS[k]) for k in ("lat0", "lat1", "lat2"))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    cc = m(p1) ** 2 + n * q(p1)
    rho0 = a * math.sqrt(cc - n * q(p0)) / n
    return {"a": a, "e2": e2, "e": e, "n": n, "C": cc, "rho0": rho0,
            "lon0": math.radians(C.ALBERS["lon0"]),
            "fe": C.ALBERS["false_easting"], "fn": C.ALBERS["false_northing"]}


ALBERS_K = _albers_constants()


def albers_xy(lat, lon) -> tuple[Column, Column]:
    k = ALBERS_K
    phi = F.radians(col(lat))
    s = F.sin(phi)
    e, e2 = k["e"], k["e2"]
    q = (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))
    rho = k["a"] * F.sqrt(k["C"] - k["n"] * q) / k["n"]
    theta = k["n"] * (F.radians(col(lon)) - k["lon0"])
    x = rho * F.sin(theta) + k["fe"]
    y = k["rho0"] - rho * F.cos(theta) + k["fn"]
    return x, y


def albers_latlon(x, y, iterations: int = 5) -> tuple[Column, Column]:
    """Inverse projection.  The latitude is refined by a fixed number of
    fixed-point steps written as one ``aggregate`` over a short array, so the
    expression stays linear in size (an unrolled loop would repeat the
    previous step several times per step and grow exponentially)."""
    k = ALBERS_K
    n, a, e, e2 = k["n"], k["a"], k["e"], k["e2"]
    dx = col(x) - k["fe"]
    dy = k["rho0"] - (col(y) - k["fn"])
    sgn = 1.0 if n > 0 else -1.0
    rho2 = dx * dx + dy * dy
    q = (k["C"] - rho2 * (n * n) / (a * a)) / n
    theta = F.atan2(sgn * dx, sgn * dy)

    def step(phi, _):
        s = F.sin(phi)
        return phi + ((1 - e2 * s * s) ** 2) / (2 * F.cos(phi)) * (
            q / (1 - e2) - s / (1 - e2 * s * s) + (1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))

    phi = F.aggregate(F.array_repeat(F.lit(0), iterations), F.asin(q / 2.0), step)
    return F.degrees(phi), F.degrees(k["lon0"] + theta / n)
