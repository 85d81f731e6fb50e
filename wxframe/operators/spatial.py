"""Spatial operators: lat/lon cell grid, extent polygon, Albers projection,
inverse-distance fill, observation/forecast overlay and convex hull."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.columns import add_hours, albers_latlon, albers_xy, null_nonfinite
from . import select as S


def build_grid(extent: DataFrame, size_km: float = C.GRID_SIZE_KM, km_per_deg: float = C.KM_PER_DEGREE,
               lat_min: str = "lat_min", lat_max: str = "lat_max", lon_min: str = "lon_min",
               lon_max: str = "lon_max") -> DataFrame:
    """Cells of about ``size_km`` over the extent row(s).

    Latitude step is constant (size / km per degree); each latitude row gets
    its own longitude step size / (km per degree * cos(lat)).  Centres start
    half a step inside the minimum and stay below the maximum.  Returns
    (row, col, lat, lon, lat_s, lat_n, lon_w, lon_e).  Rows are spread over
    the cluster by hashing the row number before the columns are generated.
    """
    dlat = size_km / km_per_deg
    start = F.col(lat_min) + dlat / 2
    n_lat = F.ceil((F.col(lat_max) - start) / dlat)
    rows = (extent.select(lon_min, lon_max, start.alias("_s"),
                          F.explode(_upto(n_lat)).alias("row"))
            .repartition("row"))
    lat_c = F.col("_s") + F.col("row") * dlat
    rows = rows.withColumn("lat", lat_c)
    dlon = size_km / (km_per_deg * F.cos(F.radians("lat")))
    rows = rows.withColumn("_dlon", dlon).withColumn("_ls", F.col(lon_min) + F.col("_dlon") / 2)
    n_lon = F.ceil((F.col(lon_max) - F.col("_ls")) / F.col("_dlon"))
    cells = rows.withColumn("col", F.explode(_upto(n_lon)))
    lon_c = F.col("_ls") + F.col("col") * F.col("_dlon")
    return cells.select(
        F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "lat", lon_c.alias("lon"),
        (F.col("lat") - dlat / 2).alias("lat_s"), (F.col("lat") + dlat / 2).alias("lat_n"),
        (lon_c - F.col("_dlon") / 2).alias("lon_w"), (lon_c + F.col("_dlon") / 2).alias("lon_e"))


def _upto(n):
    """[0, n) as an array column; empty when n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def extent_polygon(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bounding rectangle of a point table as 4 ordered corners (SW, SE, NE, NW)."""
    e = S.extent(points, lat, lon)
    corners = F.array(
        F.struct(F.lit(0).alias("corner"), F.col("lat_min").alias("lat"), F.col("lon_min").alias("lon")),
        F.struct(F.lit(1).alias("corner"), F.col("lat_min").alias("lat"), F.col("lon_max").alias("lon")),
        F.struct(F.lit(2).alias("corner"), F.col("lat_max").alias("lat"), F.col("lon_max").alias("lon")),
        F.struct(F.lit(3).alias("corner"), F.col("lat_max").alias("lat"), F.col("lon_min").alias("lon")),
    )
    return e.select(F.explode(corners).alias("c")).select("c.*")


def project(df: DataFrame, lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y") -> DataFrame:
    """Add Albers equal-area (GDA94 Australian Albers) metres."""
    xx, yy = albers_xy(lat, lon)
    return df.withColumns({x: xx, y: yy})


def unproject(df: DataFrame, x: str = "x", y: str = "y", lat: str = "lat", lon: str = "lon") -> DataFrame:
    la, lo = albers_latlon(x, y)
    return df.withColumns({lat: la, lon: lo})


POINT_BLOCK = 2048              # fill points in one block
STATION_BLOCK = 2048            # stations in one block
DISTANCES = 1 << 18             # distances that a task holds at a time
BATCH_BYTES = 4 << 20           # Arrow batches: a row holds two blocks


def idw(obs: DataFrame, points: DataFrame, stations: DataFrame, time_col: str = "time", value: str = "value",
        power: float = C.IDW_POWER, eps: float = C.IDW_EPS, point_block: int = POINT_BLOCK,
        station_block: int = STATION_BLOCK) -> DataFrame:
    """Inverse-distance fill: (time, point_id, value) for every time with a finite value and every point.

    A station within ``eps`` (projected metres) wins outright, the first by name (of several values the smallest);
    otherwise sum(w v) / sum(w) over the values reported at that time, w = 1 / (distance + eps) ** power.

    The values of a station and time are added up first.  The stations of a time become blocks of about
    ``station_block``, the points blocks of ``point_block``; a task computes one block against another as a matrix
    product, some points at a time.  Arrow batches are bounded by bytes, as their rows are long.  Times of one block have their result at once; for crowded times the blocks' numerators, denominators and
    first stations within ``eps`` are merged per (time, point).  ``points``: (point_id, lat, lon).
    """
    at = project(stations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), x="sx", y="sy") \
        .select("station", "sx", "sy")
    told = (obs.select("station", F.col(time_col).alias("_t"), null_nonfinite(value).alias("_v")).where(F.col("_v").isNotNull())
            .join(at, "station").groupBy("_t", "station", "sx", "sy")
            .agg(F.sum("_v").alias("s"), F.count("_v").cast("double").alias("n"), F.min("_v").alias("v")))
    entry = F.array_sort(F.collect_list(F.struct("station", "s", "n", "v", "sx", "sy"))).alias("o")
    crowded = told.groupBy("_t").agg(F.ceil(F.count(F.lit(1)) / station_block).alias("_blocks")).where("_blocks > 1")
    whole = told.join(crowded, "_t", "left_anti").groupBy("_t").agg(entry)
    cut = told.join(crowded, "_t").groupBy("_t", F.pmod(F.xxhash64("station"), "_blocks").alias("_k")).agg(entry)

    p = project(points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), x="px", y="py")
    blocks = p.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / point_block)).cast("long")).scalar()
    dealt = p.withColumn("block", F.pmod(F.xxhash64("point_id"), blocks)) \
        .groupBy("block").agg(F.collect_list(F.struct("point_id", "px", "py")).alias("p"))
    item = T.StructType([points.schema["point_id"], T.StructField("num", T.DoubleType()), T.StructField("den", T.DoubleType()),
                         T.StructField("station", at.schema["station"].dataType), T.StructField("v", T.DoubleType())])

    obs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def sums(frames: DataFrame) -> DataFrame:
        met = frames.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).join(dealt, "block")
        kind = T.StructType([T.StructField("_t", met.schema["_t"].dataType), T.StructField("r", T.ArrayType(item))])
        return met.select("_t", "o", "p").mapInArrow(_idw_blocks(power, eps), kind).select("_t", F.inline("r"))

    on = F.when(F.col("station").isNotNull(), F.struct("station", "v"))
    merged = sums(cut).groupBy("_t", "point_id").agg(F.sum("num").alias("num"), F.sum("den").alias("den"),
                                                     F.min(on).alias("_on")).withColumn("v", F.col("_on.v"))
    out = [f.select(F.col("_t").alias(time_col), "point_id", F.coalesce("v", F.col("num") / F.col("den")).alias("value"))
           for f in (sums(whole), merged)]
    return out[0].unionByName(out[1])


def _idw_blocks(power: float, eps: float):
    """Task of :func:`idw`: one row (time, block of stations, block of points) at a time."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["point_id", "num", "den", "station", "v"]
        for batch in batches:
            if not batch.num_rows:
                continue
            obs, pts = batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                o, p, found = obs[k].values, pts[k].values, []
                s, n, sx, sy = (o.field(c).to_numpy(zero_copy_only=False) for c in ("s", "n", "sx", "sy"))
                step = max(1, DISTANCES // len(s))
                for start in range(0, len(p), step):
                    part = p.slice(start, step)
                    px, py = (part.field(c).to_numpy(zero_copy_only=False) for c in ("px", "py"))
                    d = np.hypot(sx[:, None] - px, sy[:, None] - py)
                    near = d < eps                # rows are sorted by station name, so the first is the smallest
                    w = 1.0 / (d + eps) ** power
                    first = pa.array(near.argmax(0), mask=~near.any(0))
                    found.append(pa.StructArray.from_arrays(
                        [part.field("point_id"), pa.array(s @ w), pa.array(n @ w), o.field("station").take(first), o.field("v").take(first)],
                        names=names))
                offsets = pa.array([0, len(p)], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.ListArray.from_arrays(offsets, pa.concat_arrays(found))],
                                                 names=["_t", "r"])

    return run


def overlay(obs: DataFrame, stations: DataFrame, forecast: DataFrame, var: str, fc_var: str,
            cell: float = 0.25) -> DataFrame:
    """Observation next to the forecast of the nearest grid cell.

    Station -> nearest cell by rounding to the grid spacing (an equi-join);
    observation time floored to the hour = forecast valid time; the latest
    run of a cell and valid time wins.  Equal observations stay as many rows
    as they are.  Adds ``diff = value - forecast``.
    """
    st = stations.select("station", (F.round(F.col("lat") / cell) * cell).alias("latitude"),
                         (F.round(F.col("lon") / cell) * cell).alias("longitude"))
    o = (obs.where(F.col("variable") == var)
         .select("station", "time", null_nonfinite("value").alias("value"),
                 F.date_trunc("hour", "time").cast("timestamp_ntz").alias("valid_time"))
         .join(st, "station", "inner"))
    # the latest run for each cell and valid time, before the join: every observation then meets one row
    fc = forecast.select("latitude", "longitude", add_hours("time", F.col("step")).alias("valid_time"),
                         F.struct(F.col("time").alias("run_time"), "step", F.col(fc_var).alias("forecast")).alias("_f"))
    latest = fc.groupBy("latitude", "longitude", "valid_time").agg(F.max_by("_f", "_f.run_time").alias("_f"))
    return o.join(latest, ["latitude", "longitude", "valid_time"], "inner").select(
        "station", "time", "value", "latitude", "longitude", "valid_time", "_f.run_time", "_f.step", "_f.forecast",
        (F.col("value") - F.col("_f.forecast")).alias("diff"))


# ---------------------------------------------------------------------------
# convex hull
# ---------------------------------------------------------------------------

HULL_EPS = 1e-12                # turns smaller than this (square degrees) are straight
HULL_GROUPS = 16                # groups of partition hulls before the last step


def hull_order(x, y):
    """Row numbers of the hull's corners, counter-clockwise from the lowest (x, y).

    By splitting: from the two extreme points, the point farthest outside a side becomes a corner and splits the side
    in two.  Among equally far points the one farthest along the side is a corner; points on a side are none."""
    import numpy as np

    order = np.lexsort((y, x))
    if len(order) < 2:
        return order.tolist()

    def corners(i, j, rows):
        dx, dy = x[j] - x[i], y[j] - y[i]
        out = dy * (x[rows] - x[i]) - dx * (y[rows] - y[i])        # distance to the right of the side, scaled
        rows, out = rows[out > HULL_EPS], out[out > HULL_EPS]
        if not len(rows):
            return []
        far = rows[out >= out.max() - HULL_EPS]
        k = far[np.argmax(dx * x[far] + dy * y[far])]
        return [*corners(i, k, rows), int(k), *corners(k, j, rows)]

    i, j = int(order[0]), int(order[-1])
    return [i, *corners(i, j, order), j, *corners(j, i, order)]


def _hull_rows(table, by):
    """The rows of a pandas frame that are corners of their group's hull."""
    import pandas as pd

    groups = table.groupby(by, sort=False, dropna=False) if by else [((), table)]
    kept = [g.iloc[hull_order(g["lon"].to_numpy(), g["lat"].to_numpy())] for _, g in groups]
    return pd.concat(kept) if kept else table


def considered(points: DataFrame, exclude=C.HULL_EXCLUDE_STATIONS) -> DataFrame:
    """Stations that take part in the hull: with coordinates, and not excluded by name."""
    return points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.col("station").isin(list(exclude)))


def convex_hull(points: DataFrame, by=(), exclude=C.HULL_EXCLUDE_STATIONS) -> DataFrame:
    """Hull boundary rows (by..., seq, station, lat, lon, n_vertices, hull_type).

    Of stations at one place the first by name counts, so the result does not depend on the order of rows.  Every
    partition keeps its hull, then every one of a few groups of those; what reaches the last step is HULL_GROUPS
    hulls at most (the hull of a union is the hull of the hulls).  Fewer than two places give no rows, two or places
    on one line a polyline.
    """
    by = list(by)
    places = considered(points, exclude).groupBy(*by, "lon", "lat").agg(F.min("station").alias("station"))

    def reduce(frames):
        import pandas as pd

        kept = None
        for frame in frames:
            kept = _hull_rows(frame if kept is None else pd.concat([kept, frame]), by)
        if kept is not None:
            yield kept

    for parts in (None, HULL_GROUPS):
        places = (places if parts is None else places.repartition(parts, "lon", "lat")).mapInPandas(reduce, places.schema)
    names = T.StructType([places.schema[k] for k in by]).add("seq", "long").add("station", "string").add("lat", "double") \
        .add("lon", "double").add("n_vertices", "long").add("hull_type", "string")

    def last(frame):
        hull = _hull_rows(frame, [])
        hull = hull if len(hull) > 1 else hull.iloc[:0]
        hull = hull.assign(seq=range(len(hull)), n_vertices=len(hull), hull_type="polyline" if len(hull) == 2 else "polygon")
        return hull[names.names]

    whole = places if by else places.withColumn("one", F.lit(0))
    return whole.groupBy(*(by or ["one"])).applyInPandas(last, names)


def hull_interior(points: DataFrame, hull: DataFrame, exclude=C.HULL_EXCLUDE_STATIONS) -> DataFrame:
    """Considered stations that are not hull vertices (anti-join)."""
    return considered(points, exclude).join(hull.select("station"), "station", "left_anti")
