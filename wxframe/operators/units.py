"""Unit conversion, missing-value sentinels and lead-time decoding."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import is_missing_value


def _apply(op: str, k: float, c: Column) -> Column:
    if op == "sub":
        return c - F.lit(k)
    if op == "div":
        return c / F.lit(k)
    if op == "mul":
        return c * F.lit(k)
    raise ValueError(op)


def conversion_targets(columns, groups, match: str = "exact") -> dict[str, list[str]]:
    """For each group, the column names it converts.

    ``match='exact'``: the name is listed.  ``match='levels'``: the name is
    listed or is a listed base followed by digits (``t`` -> ``t250``).
    """
    out = {}
    for g, names in groups.items():
        hits = []
        for c in columns:
            if c in names or (match == "levels" and any(re.match(rf"^{b}\d+$", c) for b in names)):
                hits.append(c)
        out[g] = hits
    return out


def convert_units(df: DataFrame, groups=C.REANALYSIS_UNIT_GROUPS, match: str = "exact",
                  rules=C.UNIT_RULES) -> tuple[DataFrame, dict[str, str]]:
    """Convert variables in place; returns (frame, {column: new unit}).

    Groups apply in order; a column matched by two groups is converted twice,
    once per group, as the configuration dictates.
    """
    exprs: dict[str, Column] = {}
    units: dict[str, str] = {}
    for g, cols in conversion_targets(df.columns, groups, match).items():
        op, k, unit = rules[g]
        for c in cols:
            exprs[c] = _apply(op, k, exprs.get(c, F.col(c)))
            units[c] = unit
    return (df.withColumns(exprs) if exprs else df), units


def null_missing(df: DataFrame, missing: dict[str, float]) -> DataFrame:
    """Per variable, values close to its declared missing value become NULL."""
    return df.withColumns({
        c: F.when(is_missing_value(c, mv), F.lit(None).cast("double")).otherwise(F.col(c))
        for c, mv in missing.items() if c in df.columns
    })


def count_missing(df: DataFrame, missing: dict[str, float]) -> DataFrame:
    """(variable, n_missing): how many values each variable's sentinel replaces."""
    present = [(c, mv) for c, mv in missing.items() if c in df.columns]
    row = df.agg(*[F.count_if(is_missing_value(c, mv)).alias(c) for c, mv in present])
    return row.unpivot([], [c for c, _ in present], "variable", "n_missing")
