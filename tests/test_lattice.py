"""Fill lattice against a plain scan over every place."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wxframe.operators import lattice as L
from wxframe.operators import spatial as G

R = 10_000.0
X0, Y0 = -900_000.0, -3_300_000.0                       # projected metres, inland


def ring_of(spark, corners, g=None):
    rows = [(g, k, X0 + x, Y0 + y) for k, (x, y) in enumerate(corners)]
    return G.unproject(spark.createDataFrame(rows, "g string, seq long, x double, y double"))


def stations_of(spark, places, g=None):
    return G.unproject(spark.createDataFrame([(g, X0 + x, Y0 + y) for x, y in places], "g string, x double, y double"))


def edges_distance(x, y, xs, ys):
    best, inside = math.inf, False
    for ax, ay, bx, by in zip(xs, ys, [*xs[1:], xs[0]], [*ys[1:], ys[0]]):
        ex, ey = bx - ax, by - ay
        t = min(1, max(0, ((x - ax) * ex + (y - ay) * ey) / (ex * ex + ey * ey)))
        best = min(best, math.hypot(x - ax - t * ex, y - ay - t * ey))
        if (ay <= y) != (by <= y) and ax + (y - ay) / ey * ex > x:
            inside = not inside
    return best if inside else -1.0


def plain(xs, ys, stations, boxes, scale, part_of):
    """Every place of every part's lattice, one after the other; ``part_of`` tells places of different parts apart."""
    dx, dy = L.spacing(R, scale)
    taken, out = list(stations), []
    for part, (x0, y0, x1, y1) in enumerate(boxes):
        for row in range(int((y1 - y0) / dy) + 2):
            y = y0 + row * dy
            for col in range(int((x1 - x0) / dx) + 4):
                x = x0 - dx + (R if row % 2 else 0.0) + col * dx
                if edges_distance(x, y, xs, ys) < R * (1 - 1e-7) or part_of(x, y) != part:
                    continue
                if all((x - p) ** 2 + (y - q) ** 2 >= (1.8 * R) ** 2 for p, q in taken):
                    taken.append((x, y))
                    out.append((part, row, col))
    return out


def compare(spark, corners, places, scale=0.5, tile=L.TILE, part_of=lambda x, y: 0, boxes=None):
    ring, st = ring_of(spark, corners), stations_of(spark, places)
    o = L.outlines(ring).collect()[0]
    shrunk = L.Shrunk(o.xs, o.ys, R)
    boxes = shrunk.parts if boxes is None else boxes
    at = [(r.x, r.y) for r in G.project(st.drop("x", "y")).collect()]
    got = L.fill_points(ring, st, R, scale, tile=tile).orderBy("fill_id").collect()
    assert [r.fill_id for r in got] == list(range(len(got)))
    want = plain(o.xs, o.ys, at, boxes, scale, part_of)
    assert [(r.part, r.row, r.col) for r in got] == want
    return got, shrunk


@pytest.mark.parametrize("scale", [0.25, 0.4, 0.5, 0.77, 3.0])
def test_convex_outline_in_scan_order(spark, scale):
    rnd = random.Random(int(scale * 100))
    corners = [(0, 0), (160e3, 14e3), (230e3, 120e3), (120e3, 190e3), (-30e3, 90e3)]
    places = [(rnd.uniform(-20e3, 220e3), rnd.uniform(-20e3, 190e3)) for _ in range(12)]
    got, _ = compare(spark, corners, places, scale)
    assert len(got) > 20


def test_small_tiles_give_the_same_points(spark):
    corners = [(0, 0), (90e3, 14e3), (130e3, 70e3), (60e3, 110e3), (-30e3, 50e3)]
    for scale in (0.5, 0.9):
        compare(spark, corners, [(40e3, 40e3)], scale, tile=9)


def test_outline_with_a_bay_and_two_parts(spark):
    # two rooms joined by a corridor narrower than two radii: two parts, each with a lattice of its own; they reach into
    # the corridor's mouths, as far as its corners allow
    w = 6e3
    corners = [(0, 0), (80e3, 0), (80e3, 40e3 - w), (100e3, 40e3 - w), (100e3, 10e3), (190e3, 10e3), (190e3, 90e3),
               (100e3, 90e3), (100e3, 40e3 + w), (80e3, 40e3 + w), (80e3, 80e3), (0, 80e3)]
    got, shrunk = compare(spark, corners, [(30e3, 30e3)], part_of=lambda x, y: int(x > X0 + 90e3))
    assert len(shrunk.parts) == 2 and {r.part for r in got} == {0, 1}
    mouth = math.sqrt(R * R - w * w)
    want = [(X0 + R, Y0 + R, X0 + 80e3 - mouth, Y0 + 70e3), (X0 + 100e3 + mouth, Y0 + 20e3, X0 + 180e3, Y0 + 80e3)]
    assert np.allclose(shrunk.parts, want, atol=1e-3)
    # a bay cut into a square: one part, not convex, with a corner that points inwards
    bay = [(0, 0), (150e3, 0), (150e3, 150e3), (90e3, 150e3), (75e3, 60e3), (60e3, 150e3), (0, 150e3)]
    got, shrunk = compare(spark, bay, [])
    assert len(shrunk.parts) == 1
    assert compare(spark, bay[::-1], [])[0] == got                        # either way round


def test_crowded_stations_and_regions(spark):
    corners = [(0, 0), (120e3, 0), (120e3, 100e3), (0, 100e3)]
    rnd = random.Random(2)
    crowd = [(60e3 + rnd.uniform(-9e3, 9e3), 50e3 + rnd.uniform(-9e3, 9e3)) for _ in range(3000)]
    got, _ = compare(spark, corners, crowd)
    assert all(math.hypot(r.x - X0 - x, r.y - Y0 - y) >= 1.8 * R - 1e-3 for r in got for x, y in crowd[:50])
    shift = [(x + 300e3, y) for x, y in corners]
    ring = ring_of(spark, corners, "a").unionByName(ring_of(spark, shift, "b")).unionByName(ring_of(spark, [(0, 0), (9, 9)], "c"))
    st = stations_of(spark, crowd, "a").unionByName(stations_of(spark, [(0, 0)], "b"))
    both = {}
    for r in L.fill_points(ring, st, R, by=["g"]).orderBy("g", "fill_id").collect():
        both.setdefault(r.g, []).append((r.part, r.row, r.col))
    assert both["a"] == [(r.part, r.row, r.col) for r in got] and set(both) == {"a", "b"}
    assert both["b"] == [(r.part, r.row, r.col) for r in compare(spark, shift, [(0, 0)])[0]]


def test_nothing_to_fill(spark):
    thin = [(0, 0), (200e3, 0), (200e3, 19e3), (0, 19e3)]
    for corners in (thin, [(0, 0), (50e3, 0)], [(0, 0), (50e3, 0), (100e3, 0)], []):
        assert L.fill_points(ring_of(spark, corners), stations_of(spark, []), R).collect() == []


def test_no_task_holds_the_whole_lattice(spark):
    corners = [(0, 0), (400e3, 0), (400e3, 300e3), (0, 300e3)]
    parts = L.shrunk_parts(L.outlines(ring_of(spark, corners)), R)
    points = L.candidates(parts, R, 0.5)
    assert points.count() > 1000
    plan = L.candidates(parts, R, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "first" in plan             # rows are laid out by blocks
    taken = L.first_apart(points, R, 0.5, tile=16)
    per_tile = taken.groupBy("ti", "tj").count().collect()
    assert len(per_tile) > 10 and max(r["count"] for r in per_tile) <= 16 * 16
