"""Pressure-level flattening: tall (…, level, var) -> wide var{level} columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_levels(df: DataFrame, keys, variables, levels, level_col: str = "level") -> DataFrame:
    """One column ``{var}{level}`` per variable and listed level.

    Conditional aggregation over the known level list: one hash aggregate on
    the keys, partial on the map side, no pivot discovery job.  Returns an
    empty frame (keys only, no rows) when there is no level column or no
    level variable.
    """
    keys = list(keys)
    variables = [v for v in variables if v in df.columns]
    if level_col not in df.columns or not variables:
        return df.select(*keys).limit(0)
    lv = F.col(level_col)
    aggs = [F.max(F.when(lv == F.lit(int(L)), F.col(v))).alias(f"{v}{int(L)}")
            for v in variables for L in levels]
    return df.groupBy(*keys).agg(*aggs)


def nearest_levels(df: DataFrame, targets, level_col: str = "level", descending: bool = False):
    """For each target, the present level with the smallest absolute
    difference (ties: first in stored order, ascending unless ``descending``),
    as scalar-subquery columns keyed by target."""
    present = df.select(F.col(level_col).cast("int").alias("_lv")).distinct()
    tie = F.col("_lv") * (-1 if descending else 1)
    return {int(t): present.agg(F.min_by("_lv", F.struct(F.abs(F.col("_lv") - F.lit(int(t))), tie))).scalar()
            for t in targets}


def flatten_levels_nearest(df: DataFrame, keys, variables, targets, level_col: str = "level",
                           descending: bool = False) -> DataFrame:
    """``{var}{target}`` columns taken from the nearest present level.

    The name carries the *target* even when the level used differs.
    """
    keys = list(keys)
    variables = [v for v in variables if v in df.columns]
    if level_col not in df.columns or not variables:
        return df.select(*keys).limit(0)
    near = nearest_levels(df, targets, level_col, descending)
    # one flag column per target (each level subquery evaluated once), then conditional aggregates
    flagged = df.withColumns({f"_at{int(t)}": F.col(level_col) == near[int(t)] for t in targets})
    aggs = [F.max(F.when(F.col(f"_at{int(t)}"), F.col(v))).alias(f"{v}{int(t)}")
            for v in variables for t in targets]
    return flagged.groupBy(*keys).agg(*aggs)


def nearest_level_table(df: DataFrame, targets, level_col: str = "level", descending: bool = False) -> DataFrame:
    """(target, level_used) rows, for reporting substitutions."""
    near = nearest_levels(df, targets, level_col, descending)
    rows = [F.struct(F.lit(int(t)).alias("target"), near[int(t)].alias("level_used")) for t in targets]
    return df.limit(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
