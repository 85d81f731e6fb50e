"""Row-order windows over long series without one-task-per-series.

A plain ``Window.partitionBy(station).orderBy(time)`` sends a whole station
to one task; a station holding a third of the data would stall the job.
Instead every row gets its exact position in its series from per-chunk
counts (a partial aggregate plus a prefix sum over the small chunk table),
the series is cut into fixed-size blocks of positions, and each block is
given ``halo`` rows of its neighbours.  Windows then run per (series, block)
and reach at most ``halo`` rows, so their results are identical to the
whole-series window while every task holds at most ``block + 2 * halo`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 50_000


def series_positions(df: DataFrame, by, order_col: str, chunk: str = "day",
                     tie_col: str | None = None) -> DataFrame:
    """Adds ``_pos``: 0-based row position within each ``by`` series in
    ``order_col`` order (``tie_col`` breaks ties), and ``_len``: the series length."""
    by = list(by)
    ch = F.date_trunc(chunk, order_col).alias("_chunk")
    d = df.withColumn("_chunk", ch)
    order = [order_col] + ([tie_col] if tie_col else [])
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(*order)) - 1)
    counts = d.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumns({"_off": F.coalesce(F.sum("_cnt").over(before), F.lit(0)),
                               "_len": F.sum("_cnt").over(Window.partitionBy(*by))}).drop("_cnt")
    return (d.join(offs, [*by, "_chunk"], "inner")
            .withColumn("_pos", F.col("_off") + F.col("_r"))
            .drop("_off", "_r", "_chunk"))


def with_halo(df: DataFrame, halo: int, block: int = DEFAULT_BLOCK, pos: str = "_pos") -> DataFrame:
    """Assign rows to position blocks (``_blk``) with ``halo`` neighbour rows
    copied into adjacent blocks; ``_core`` marks a row's own block."""
    if halo >= block:
        raise ValueError("halo must be smaller than the block")
    p = F.col(pos)
    b = F.floor(p / block)
    nxt = F.floor((p + halo) / block)
    prv = F.floor((p - halo) / block)
    # with a known series length, no halo is sent past the last block
    has_next = (nxt != b) & ((b + 1) * block < F.col("_len")) if "_len" in df.columns else (nxt != b)
    copies = F.array(
        F.struct(b.alias("_blk"), F.lit(True).alias("_core")),
        F.when(has_next, F.struct((b + 1).alias("_blk"), F.lit(False).alias("_core"))),
        F.when((prv != b) & (p >= halo), F.struct((b - 1).alias("_blk"), F.lit(False).alias("_core"))),
    )
    return (df.withColumn("_c", F.explode(F.filter(copies, lambda x: x.isNotNull())))
            .select("*", "_c._blk", "_c._core").drop("_c"))


def block_window(by, pos: str = "_pos") -> Window:
    return Window.partitionBy(*by, "_blk").orderBy(pos)
