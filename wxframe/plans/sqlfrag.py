"""Small SQL-text helpers for the DuckDB twins (same formulas as the Spark side)."""

from __future__ import annotations

from ..functions.columns import ALBERS_K


def pmod(x: str, n: str) -> str:
    """Spark's pmod for doubles: remainder with the sign of the divisor."""
    r = f"(({x}) % ({n}))"
    return f"(CASE WHEN {r} < 0 THEN ({r} + ({n})) % ({n}) ELSE {r} END)"


def nonfinite_null(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"


def hypot(u: str, v: str) -> str:
    return f"sqrt(({u}) * ({u}) + ({v}) * ({v}))"


def wind_angle(u: str, v: str) -> str:
    return pmod(f"degrees(atan2({u}, {v})) + 360.0e0", "360.0e0")


def r6(x: str) -> str:
    return f"(round(({x}) * 1e6) / 1e6)"


def lit(v: float) -> str:
    return f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))


def albers_xy(lat: str, lon: str) -> tuple[str, str]:
    k = ALBERS_K
    e, e2 = lit(k["e"]), lit(k["e2"])
    s = f"sin(radians({lat}))"
    q = (f"((1 - {e2}) * ({s} / (1 - {e2} * {s} * {s}) - (1 / (2 * {e})) * "
         f"ln((1 - {e} * {s}) / (1 + {e} * {s}))))")
    rho = f"({lit(k['a'])} * sqrt({lit(k['C'])} - {lit(k['n'])} * {q}) / {lit(k['n'])})"
    theta = f"({lit(k['n'])} * (radians({lon}) - {lit(k['lon0'])}))"
    x = f"({rho} * sin({theta}) + {lit(k['fe'])})"
    y = f"({lit(k['rho0'])} - {rho} * cos({theta}) + {lit(k['fn'])})"
    return x, y
