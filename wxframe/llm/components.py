"""Connected components of an edge table by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

EDGES = 1 << 16                  # edges in a partition of the rounds' tables
LEAST_PARTS = 8


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (two long columns); component is the smallest id reachable.

    Every round hangs each node's larger neighbours, then its smaller ones, on the smallest neighbour, until the
    edges are stars; rounds grow with the logarithm of the longest path.  Rounds never add edges, so their tables get
    as many partitions as the edges before them need.  Nulls and loops are left out.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns[:2])
    e = checkpoint(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, parts = mark, max(LEAST_PARTS, -(-mark[0] // EDGES))
        e = e.coalesce(parts)
        least = e.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("lo"), "m")
        large = e.join(least, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.inline(F.array(
            F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))))
        e = checkpoint(small.where("hi <> lo").distinct().coalesce(parts))
    # stars: a node hangs on one other, which hangs on none
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")) \
        .union(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
