"""Fill lattice: points of a regular lattice inside an outline, away from its edge, from stations and from each other.

An outline (a ring of corners, convex or not) is shrunk by a radius: what remains are the places at least that far from
every edge.  They form one or more parts; each part has a lattice of its own from the lower left corner of its box, whose
odd rows are shifted by the radius.  Lattice points are taken greedily in scan order (part, row, column): a point stays
when no station and no point taken before it lies closer than 1.8 radii.

The greedy choice runs in parallel.  Along ``front = column + slope * row`` every point depends on smaller fronts and on
rows not above its own only, so tiles of (front, row) with equal sums of their numbers don't depend on each other: one
Spark job decides all tiles of a sum at once, and needs what the two sums before it have taken.  Within a tile, fronts
follow each other.  No task sees more than one tile and its lower neighbours.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..session import stored
from .spatial import project, unproject

TILE = 256                      # fronts and rows of a tile
ROW_BLOCK = 64                  # lattice rows laid out at a time
SMALL = 1e-7                    # lengths below this share of the radius are nothing


# ---------------------------------------------------------------------------
# one outline
# ---------------------------------------------------------------------------

class Shrunk:
    """An outline shrunk by ``radius``: the places inside that are at least ``radius`` away from every edge."""

    def __init__(self, x, y, radius: float):
        p = np.stack([np.asarray(x, float), np.asarray(y, float)], 1)
        if len(p):
            p = p[np.any(p != np.roll(p, 1, axis=0), axis=1)]
        self.radius, self.parts = radius, []
        area = np.sum(p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)) if len(p) > 2 else 0.0
        self.a = p if area >= 0 else p[::-1]                  # corners counter-clockwise: inside is on the left
        if area == 0:
            return
        self.b = np.roll(self.a, -1, axis=0)
        self.d = self.b - self.a
        self.length = np.hypot(*self.d.T)
        self.pieces = self._pieces()
        self.parts = self._parts()

    def distance(self, at: np.ndarray) -> np.ndarray:
        """Distance of points from the outline."""
        rel = at[:, None] - self.a
        t = np.clip((rel * self.d).sum(2) / self.length ** 2, 0, 1)
        return np.hypot(*np.moveaxis(rel - t[:, :, None] * self.d, 2, 0)).min(1)

    def _pieces(self):
        """Boundary pieces as polylines' ends: (kind, centre or start, end or angles) cut wherever curves cross.

        Parallels of the edges and, around corners that point inwards, arcs; of the cut curves those pieces belong to the
        boundary whose middle is not nearer than the radius to any edge."""
        r, n = self.radius, len(self.a)
        normal = np.stack([-self.d[:, 1], self.d[:, 0]], 1) / self.length[:, None]
        lines = [(self.a[k] + r * normal[k], self.b[k] + r * normal[k]) for k in range(n)]
        arcs = []
        for k in range(n):
            turn = self.d[k - 1, 0] * self.d[k, 1] - self.d[k - 1, 1] * self.d[k, 0]
            if turn < 0:
                start = math.atan2(normal[k - 1, 1], normal[k - 1, 0])
                sweep = (math.atan2(normal[k, 1], normal[k, 0]) - start) % (2 * math.pi) - 2 * math.pi
                arcs.append((self.a[k], start, sweep))
        cuts = [[0.0, 1.0] for _ in range(n + len(arcs))]
        s = np.array([q[0] for q in lines])
        e = np.array([q[1] for q in lines]) - s
        for k in range(n):                                   # parallels with parallels
            cross = e[k, 0] * e[:, 1] - e[k, 1] * e[:, 0]
            rel = s - s[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (rel[:, 0] * e[:, 1] - rel[:, 1] * e[:, 0]) / cross
                u = (rel[:, 0] * e[k, 1] - rel[:, 1] * e[k, 0]) / cross
            cuts[k] += t[(t > 0) & (t < 1) & (u >= 0) & (u <= 1)].tolist()

        def on_arc(arc, at):
            t = ((math.atan2(at[1] - arc[0][1], at[0] - arc[0][0]) - arc[1]) % (2 * math.pi) - 2 * math.pi) / arc[2]
            return t if 0 <= t <= 1 else None

        for m, arc in enumerate(arcs):
            for k in range(n):                               # arcs with parallels
                rel, ee = s[k] - arc[0], e[k] @ e[k]
                h, under = (rel @ e[k]) / ee, ((rel @ e[k]) / ee) ** 2 - (rel @ rel - r * r) / ee
                for t in ((-h - math.sqrt(under), -h + math.sqrt(under)) if under >= 0 else ()):
                    v = on_arc(arc, s[k] + t * e[k])
                    if 0 <= t <= 1 and v is not None:
                        cuts[k].append(t)
                        cuts[n + m].append(v)
            for other in range(m):                           # arcs with arcs
                rel = arcs[other][0] - arc[0]
                gap = math.hypot(*rel)
                if 0 < gap <= 2 * r:
                    side = np.array([-rel[1], rel[0]]) / gap * math.sqrt(r * r - gap * gap / 4)
                    for at in (arc[0] + rel / 2 + side, arc[0] + rel / 2 - side):
                        v, w = on_arc(arc, at), on_arc(arcs[other], at)
                        if v is not None and w is not None:
                            cuts[n + m].append(v)
                            cuts[n + other].append(w)
        pieces = []
        for k, c in enumerate(cuts):
            c = np.unique(c)
            for lo, hi in zip(c[:-1], c[1:]):
                if k < n:
                    ends = [lines[k][0] + t * e[k] for t in (lo, (lo + hi) / 2, hi)]
                    size = (hi - lo) * math.hypot(*e[k])
                else:
                    centre, start, sweep = arcs[k - n]
                    ends = [centre + r * np.array([math.cos(start + t * sweep), math.sin(start + t * sweep)])
                            for t in (lo, (lo + hi) / 2, hi)]
                    size = (hi - lo) * abs(sweep) * r
                if size > SMALL * r:
                    pieces.append(ends)
        if not pieces:
            return np.zeros((0, 3, 2))
        pieces = np.array(pieces)
        return pieces[self.distance(pieces[:, 1]) >= r * (1 - SMALL)]

    def _parts(self):
        """Pieces joined at their ends are the boundary of one part; parts are ordered by their lowest, leftmost corner."""
        if not len(self.pieces):
            return []
        ends = self.pieces[:, [0, 2]].reshape(-1, 2)
        group = np.arange(len(self.pieces))
        near = self.radius * 1e-5
        for k in range(len(self.pieces)):                    # pieces with an end at an end of piece k join its group
            touch = np.zeros(len(ends), bool)
            for end in self.pieces[k, [0, 2]]:
                touch |= np.hypot(*(ends - end).T) <= near
            joined = np.unique(group[np.flatnonzero(touch) // 2])
            group[np.isin(group, joined)] = joined[0]
        corners = [ends.reshape(-1, 2, 2)[group == g].reshape(-1, 2) for g in np.unique(group)]
        order = sorted(range(len(corners)), key=lambda k: (corners[k][:, 1].min(), corners[k][:, 0].min()))
        self.part_of = np.searchsorted(np.unique(group), group)
        self.part_of = np.argsort(order)[self.part_of]
        return [(*corners[k].min(0), *corners[k].max(0)) for k in order]

    def spans(self, y: float):
        """(from, to, part) of every stretch of the horizontal line at ``y`` that lies in the shrunk outline."""
        a, b, d, r = self.a, self.b, self.d, self.radius * (1 - SMALL)             # places on the boundary belong to it
        over = (a[:, 1] <= y) != (b[:, 1] <= y)
        inside = np.sort(a[over, 0] + (y - a[over, 1]) / d[over, 1] * d[over, 0]).reshape(-1, 2)
        # the places nearer than the radius to an edge are a convex body; the line meets it in one stretch
        lo, hi = np.full(len(a), np.inf), np.full(len(a), -np.inf)
        for c in (a, b):
            half = np.sqrt(np.maximum(r * r - (y - c[:, 1]) ** 2, 0))
            meets = np.abs(y - c[:, 1]) < r
            lo, hi = np.where(meets, np.minimum(lo, c[:, 0] - half), lo), np.where(meets, np.maximum(hi, c[:, 0] + half), hi)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = (y - a[:, 1]) * d[:, 1]
            foot = np.sort(np.stack([-up, self.length ** 2 - up]) / d[:, 0], axis=0)        # foot of the perpendicular on the edge
            flat = (y - a[:, 1]) * d[:, 0]
            wide = np.sort(np.stack([flat - r * self.length, flat + r * self.length]) / d[:, 1], axis=0)
        full = np.array([-np.inf, np.inf])[:, None]
        foot = np.where(d[:, 0] == 0, np.where((up >= 0) & (up <= self.length ** 2), full, full[::-1]), foot)
        wide = np.where(d[:, 1] == 0, np.where(np.abs(flat) < r * self.length, full, full[::-1]), wide)
        left, right = np.maximum(foot[0], wide[0]), np.minimum(foot[1], wide[1])
        meets = left < right
        lo = np.where(meets, np.minimum(lo, a[:, 0] + left), lo)
        hi = np.where(meets, np.maximum(hi, a[:, 0] + right), hi)
        near = sorted((p, q) for p, q in zip(lo, hi) if p < q)
        out = []
        for start, stop in inside:
            for p, q in near:
                if q > start and p < stop:
                    if p >= start:
                        out.append((start, p))
                    start = max(start, q)
            if start <= stop:
                out.append((start, stop))
        return [(p, q, self._part(p, y)) for p, q in out if p <= q]

    def _part(self, x: float, y: float) -> int:
        if len(self.parts) == 1:
            return 0
        at = np.array([x, y])
        s, m, e = self.pieces[:, 0], self.pieces[:, 1], self.pieces[:, 2]
        best = np.full(len(s), np.inf)
        for p, q in ((s, m), (m, e)):                        # arcs as two chords: near enough to tell parts apart
            d = q - p
            t = np.clip(((at - p) * d).sum(1) / (d * d).sum(1), 0, 1)
            best = np.minimum(best, np.hypot(*(at - p - t[:, None] * d).T))
        return int(self.part_of[best.argmin()])


def spacing(radius: float, scale: float) -> tuple[float, float]:
    """(between columns, between rows) of the lattice; the scale counts from 0.25 to 1."""
    scale = max(0.25, min(scale, 1.0))
    return radius * 2.0 * scale, radius * math.sqrt(3.0) * scale


# ---------------------------------------------------------------------------
# tables
# ---------------------------------------------------------------------------

def outlines(ring: DataFrame, by=()) -> DataFrame:
    """One row (by..., xs, ys) for each ring of rows (by..., seq, lat, lon); an outline is one geometry, one row."""
    corners = project(ring.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), x="_x", y="_y")
    whole = corners.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "_x", "_y"))).alias("_c"))
    return whole.select(*by, F.col("_c._x").alias("xs"), F.col("_c._y").alias("ys"))


def shrunk_parts(outline: DataFrame, radius: float, by=()) -> DataFrame:
    """(by..., part, min_x, min_y, max_x, max_y, xs, ys): the parts that are left of each outline, none if it is too thin."""
    names = ["part", "min_x", "min_y", "max_x", "max_y"]
    kind = T.StructType([outline.schema[k] for k in by]).add("part", "integer")
    for c in names[1:]:
        kind = kind.add(c, "double")
    kind = kind.add(outline.schema["xs"]).add(outline.schema["ys"])

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(*(row[k] for k in by), part, *box, row["xs"], row["ys"])
                    for row in frame.to_dict("records")
                    for part, box in enumerate(Shrunk(row["xs"], row["ys"], radius).parts)]
            yield pd.DataFrame(rows, columns=kind.names)

    return outline.mapInPandas(run, kind)


def candidates(parts: DataFrame, radius: float, scale: float, by=()) -> DataFrame:
    """(by..., part, row, col, x, y): lattice points in their part, laid out by blocks of rows."""
    dx, dy = spacing(radius, scale)
    kind = T.StructType([parts.schema[k] for k in by]).add("part", "integer").add("row", "long").add("col", "long") \
        .add("x", "double").add("y", "double")
    last = F.floor((F.col("max_y") - F.col("min_y")) / dy + SMALL)
    blocks = parts.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(ROW_BLOCK).cast("long")))) \
        .withColumn("last", F.least(last, F.col("first") + ROW_BLOCK - 1)).repartition(*by, "part", "first")

    def run(frames):
        import pandas as pd

        known = {}
        for frame in frames:
            rows = []
            for b in frame.to_dict("records"):
                key = (*(b[k] for k in by),)
                if key not in known:
                    known = {key: Shrunk(b["xs"], b["ys"], radius)}
                for row in range(b["first"], b["last"] + 1):
                    y = b["min_y"] + row * dy
                    x0 = b["min_x"] - dx + (radius if row % 2 else 0.0)
                    for lo, hi, part in known[key].spans(y):
                        if part == b["part"]:
                            for col in range(max(0, math.ceil((lo - x0) / dx)), math.floor((hi - x0) / dx) + 1):
                                rows.append((*key, part, row, col, x0 + col * dx, y))
            yield pd.DataFrame(rows, columns=kind.names)

    return blocks.mapInPandas(run, kind)


def struck(parts: DataFrame, stations: DataFrame, radius: float, scale: float, by=()) -> DataFrame:
    """Distinct (by..., part, row, col) of lattice points closer than 1.8 radii to a station.

    Every station works out the few lattice points around it; equal ones are merged before they are shuffled, so a
    place crowded with stations is no hot key."""
    dx, dy = spacing(radius, scale)
    reach = radius * C.FILL_MIN_SEPARATION
    at = project(stations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), x="_sx", y="_sy").select(*by, "_sx", "_sy")
    boxes = parts.select(*by, F.struct("part", "min_x", "min_y", "max_x", "max_y").alias("_p"))
    if by:
        met = at.join(boxes.groupBy(*by).agg(F.collect_list("_p").alias("_p")), list(by))
    else:
        met = at.withColumn("_p", boxes.agg(F.collect_list("_p")).scalar())     # the parts of the one outline
    met = met.withColumn("_p", F.explode("_p")).where(
        F.col("_sx").between(F.col("_p.min_x") - reach, F.col("_p.max_x") + reach)
        & F.col("_sy").between(F.col("_p.min_y") - reach, F.col("_p.max_y") + reach))

    def steps(lo, hi):
        lo, hi = F.greatest(F.ceil(lo), F.lit(0)), F.floor(hi)
        return F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))

    met = met.withColumn("row", steps((F.col("_sy") - reach - F.col("_p.min_y")) / dy, (F.col("_sy") + reach - F.col("_p.min_y")) / dy))
    met = met.withColumn("_x0", F.col("_p.min_x") - dx + F.when(F.col("row") % 2 == 1, radius).otherwise(0.0)) \
        .withColumn("col", steps((F.col("_sx") - reach - F.col("_x0")) / dx, (F.col("_sx") + reach - F.col("_x0")) / dx))
    off_x = F.col("_x0") + F.col("col") * dx - F.col("_sx")
    off_y = F.col("_p.min_y") + F.col("row") * dy - F.col("_sy")
    return met.where(off_x * off_x + off_y * off_y < reach * reach).select(*by, F.col("_p.part").alias("part"), "row", "col").distinct()


def first_apart(points: DataFrame, radius: float, scale: float, by=(), tile: int = TILE) -> DataFrame:
    """Of lattice points (by..., part, row, col, x, y) those that a scan in the order (part, row, col) takes: no point
    taken before lies closer than 1.8 radii.  Adds ``front``; see the module's text for the order of the jobs."""
    dx, dy = spacing(radius, scale)
    reach = radius * C.FILL_MIN_SEPARATION
    slope = math.ceil(reach / dx) + 1
    shift = F.when(F.col("row") % 2 == 1, radius / dx).otherwise(0.0)
    rows_back = math.floor(reach / dy)
    fronts_back = math.ceil(reach / dx) + slope * rows_back + 1
    tile = max(tile, rows_back + 1, fronts_back)
    todo = stored(points.withColumn("front", F.floor(F.col("col") + shift).cast("long") + slope * F.col("row")) \
        .withColumns({"ti": F.floor(F.col("front") / tile), "tj": F.floor(F.col("row") / tile)}))
    waves = sorted({(r["part"], r["w"]) for r in todo.select("part", (F.col("ti") + F.col("tj")).alias("w")).distinct().toLocalIterator()})
    group = [*by, "part", "ti", "tj"]
    kind = todo.schema
    columns = todo.columns

    def decide(frame):
        """Points of a tile that stay; rows with ``given`` were taken before and only count."""
        given = frame["given"].to_numpy()
        place = frame[["x", "y"]].to_numpy()
        fronts = frame["front"].to_numpy()
        taken = list(np.flatnonzero(given))
        stays = []
        order = np.argsort(fronts, kind="stable")
        order = order[~given[order]]
        for rows in np.split(order, np.flatnonzero(np.diff(fronts[order])) + 1):
            if not len(rows):
                continue
            last = np.array([t for t in taken if fronts[t] >= fronts[rows[0]] - fronts_back], int)
            gap = place[rows][:, None] - place[last]
            free = rows[~((gap ** 2).sum(2) < reach * reach).any(1)]
            stays.extend(free)
            taken = [*last, *free]
        return frame.iloc[sorted(stays)][columns]

    kept: dict = {}
    for part, wave in waves:
        mine = todo.where((F.col("part") == part) & (F.col("ti") + F.col("tj") == wave)).withColumn("given", F.lit(False))
        before = [kept[part, w] for w in (wave - 1, wave - 2) if (part, w) in kept]
        for done in before:                                  # taken points count in the tiles above and to the right
            spread = F.explode(F.array(*[F.struct((F.col("ti") + i).alias("ti"), (F.col("tj") + j).alias("tj"))
                                         for i, j in ((0, 1), (1, 0), (1, 1))]))
            reached = done.withColumn("_t", spread).withColumns({"ti": F.col("_t.ti"), "tj": F.col("_t.tj")}).drop("_t")
            reached = reached.where(F.col("ti") + F.col("tj") == wave).withColumn("given", F.lit(True))
            mine = mine.unionByName(reached)
        if part > 0:                                         # other parts have lattices of their own
            mine = _not_near(mine, [k for (p, _), k in kept.items() if p < part], reach, by)
        kept[part, wave] = stored(mine.groupBy(*group).applyInPandas(decide, kind))
    return reduce(DataFrame.unionByName, kept.values()) if kept else todo.limit(0)


def _not_near(points: DataFrame, taken: list[DataFrame], reach: float, by) -> DataFrame:
    """Points with no taken one of another part closer than ``reach``: an equi-join on cells of that size, of which a
    cell holds a few lattice points only."""
    if not taken:
        return points
    others = reduce(DataFrame.unionByName, taken).select(*by, F.col("x").alias("_ox"), F.col("y").alias("_oy")) \
        .withColumns({"_cx": F.floor(F.col("_ox") / reach), "_cy": F.floor(F.col("_oy") / reach)})
    around = F.explode(F.array(*[F.struct((F.floor(F.col("x") / reach) + i).alias("_cx"), (F.floor(F.col("y") / reach) + j).alias("_cy"))
                                 for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    keys = [*by, "part", "row", "col"]
    near = points.select(*keys, "x", "y", around.alias("_c")).select("*", "_c.*").join(others, [*by, "_cx", "_cy"]) \
        .where((F.col("x") - F.col("_ox")) ** 2 + (F.col("y") - F.col("_oy")) ** 2 < reach * reach).select(*keys).distinct()
    return points.join(near, keys, "left_anti")


def fill_points(ring: DataFrame, stations: DataFrame, radius: float = C.FILL_RADIUS_M, scale: float = C.FILL_PACKING_SCALE,
                by=(), tile: int = TILE) -> DataFrame:
    """(by..., fill_id, part, row, col, x, y, lat, lon): the fill lattice of each ring, ``fill_id`` in scan order from 0.

    ``ring``: (by..., seq, lat, lon), as :func:`spatial.convex_hull` gives it; ``stations``: (by..., lat, lon).  Fewer
    than three corners, an outline without area or one thinner than two radii give no points.
    """
    by = list(by)
    parts = stored(shrunk_parts(outlines(ring, by), radius, by))
    free = candidates(parts, radius, scale, by).join(struck(parts, stations, radius, scale, by), [*by, "part", "row", "col"], "left_anti")
    taken = first_apart(free, radius, scale, by, tile)
    # numbers in scan order: points before a row from the rows' counts, the place in the row by its columns
    counts = taken.groupBy(*by, "part", "row").agg(F.count(F.lit(1)).alias("_n"))
    scan = Window.partitionBy(*by).orderBy("part", "row")
    before = counts.select(*by, "part", "row", (F.sum("_n").over(scan) - F.col("_n")).alias("_before"))
    in_row = F.row_number().over(Window.partitionBy(*by, "part", "row").orderBy("col")) - 1
    numbered = taken.withColumn("_k", in_row).join(before, [*by, "part", "row"])
    return unproject(numbered, "x", "y", "lat", "lon").select(
        *by, (F.col("_before") + F.col("_k")).alias("fill_id"), "part", "row", "col", "x", "y", "lat", "lon")
