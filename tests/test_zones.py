"""Trees of cells and the validity of zones against plain geometry."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityflux.functions import cells, geo
from cityflux.sources import readers

ZONES = "zone_id int, rings array<struct<xs: array<double>, ys: array<double>>>"


def star(r, n, x, y, size):
    at = sorted(r.random() * 2 * math.pi for _ in range(n))
    return [x + math.cos(a) * size * (0.4 + 0.6 * r.random()) for a in at], [y + math.sin(a) * size * (0.4 + 0.6 * r.random()) for a in at]


def frame(spark, zones):
    return spark.createDataFrame([(z, [{"xs": list(map(float, x)), "ys": list(map(float, y))} for x, y in rings]) for z, rings in zones], ZONES)


def odd(edges, px, py):
    x1, y1, x2, y2 = edges.T
    return bool((((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / np.where(y1 == y2, 1, y2 - y1) + x1)).sum() % 2)


@pytest.mark.parametrize("seed", range(6))
def test_leaves_answer_as_the_whole_polygon(seed, monkeypatch):
    monkeypatch.setattr(cells, "MOST_EDGES", [1, 2, 4, 16][seed % 4])
    r = random.Random(seed)
    rings = [star(r, r.choice([3, 5, 40, 300]), r.random(), r.random(), r.random()) for _ in range(1 + seed)]
    if seed == 1:  # many points at heights and places of vertices
        rings = [([round(8 * v) / 8 for v in x], [round(8 * v) / 8 for v in y]) for x, y in rings]
    grid = cells.Grid.over(-1, 2.5, -1.5, 2.5)
    edges, _ = cells.edges_of(rings)
    found = {}
    for leaf in cells.leaves(edges, grid):
        assert (leaf.level, leaf.cx, leaf.cy) not in found
        found[leaf.level, leaf.cx, leaf.cy] = leaf
    points = [(r.uniform(-1, 2.5), r.uniform(-1.5, 2.5)) for _ in range(1500)] + [(r.randrange(-8, 20) / 8, r.randrange(-12, 20) / 8) for _ in range(300)] + [(x, y) for xs, ys in rings for x, y in zip(xs, ys[1:], strict=False)]
    for px, py in points:
        own = [x for level in range(cells.DEEPEST + 1) if (x := found.get((level, int((px - grid.x) // grid.side(level)), int((py - grid.y) // grid.side(level)))))]
        assert len(own) <= 1
        got = bool(own) and own[0].flag ^ cells.parity(own[0].edges, own[0].right, px, py)
        assert got == odd(edges, px, py), (px, py)


def test_a_detailed_zone_has_small_leaves():
    r = random.Random(0)
    at = np.linspace(0, 2 * math.pi, 20001)[:-1]
    size = 1 + 0.1 * np.array([r.random() for _ in at])
    edges, _ = cells.edges_of([(np.cos(at) * size, np.sin(at) * size)])
    found = list(cells.leaves(edges, cells.Grid.over(-1.2, 1.2, -1.2, 1.2)))
    assert max(len(x.edges) for x in found) <= cells.MOST_EDGES
    assert sum(len(x.edges) for x in found) < 16 * len(edges)  # edges as long as hundreds of them are apart; the whole rings in each cell would be thousands of times that


def test_zones_against_the_plain_test(spark, monkeypatch):
    r = random.Random(4)
    # stars in cells of their own, of very different sizes and numbers of vertices
    zones = [(k, [star(r, r.choice([3, 12, 500]), 3 * (k % 6) + 1.5, 3 * (k // 6) + 1.5, r.choice([0.02, 0.5, 1.4])), *([([3 * (k % 6) + 1.45, 3 * (k % 6) + 1.55, 3 * (k % 6) + 1.5], [3 * (k // 6) + 1.45, 3 * (k // 6) + 1.45, 3 * (k // 6) + 1.55])] if k % 4 == 0 else [])]) for k in range(30)]
    points = [(n, r.uniform(-1, 20), r.uniform(-1, 17)) for n in range(2000)] + [(3000 + k, x[0], y[0]) for k, rings in zones for x, y in rings] + [(9000, None, 1.0), (9001, math.nan, 1.0), (9002, math.inf, 1.0), (9003, 1.0, None)]
    df, shapes = spark.createDataFrame(points, "id int, x double, y double"), frame(spark, zones)
    whole = df.crossJoin(F.broadcast(shapes)).where(geo.inside(F.col("x"), F.col("y"), F.col("rings"))).select("id", "zone_id")
    want = {r["id"]: r["zone_id"] for r in whole.collect()}
    assert len(set(want.values())) > 12
    for limit in (geo.MOST_BYTES, 0):
        monkeypatch.setattr(geo, "MOST_BYTES", limit)
        got = geo.assign_zones(df, shapes, "x", "y").collect()
        assert len(got) == len(points)
        assert {r["id"]: r["zone_id"] for r in got if r["zone_id"] is not None} == want
    plan = geo.assign_zones(df, shapes, "x", "y")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan


def test_points_of_no_zones(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id int, x double, y double")
    for zones in ([], [(1, [])], [(1, [([], [])])], [(1, [([0, 1], [0, 1])])]):
        assert [(r["zone_id"], r["status"]) for r in geo.assign_zones(points, frame(spark, zones), "x", "y").collect()] == [(None, geo.OUTSIDE)]


SQUARE = ([0, 2, 2, 0], [0, 0, 2, 2])
moved = lambda ring, dx, dy=0.0: ([x + dx for x in ring[0]], [y + dy for y in ring[1]])
small = lambda ring, by: ([x * by for x in ring[0]], [y * by for y in ring[1]])
FAULTS = {
    "bow tie": ([SQUARE[0], [0, 2, 0, 2]], "CROSSING"),
    "crossing hole": ([SQUARE, moved(SQUARE, 1.5, 0.5)], "CROSSING"),
    "spike": ([([0, 2, 2, 4, 2, 0], [0, 0, 1, 1, 1, 2])], "OVERLAPPING_EDGES"),
    "two rings on one edge": ([SQUARE, moved(SQUARE, 2)], "OVERLAPPING_EDGES"),
    "twice the same ring": ([SQUARE, SQUARE], "OVERLAPPING_EDGES"),
    "eight": ([([0, 1, 2, 2, 1, 0], [0, 1, 0, 2, 1, 2])], "SELF_TOUCH"),
    "vertex on an edge": ([([0, 4, 4, 2, 0], [0, 0, 4, 0, 4])], "SELF_TOUCH"),
    "no area": ([([0, 1], [0, 1])], "EMPTY_RING"),
}


@pytest.mark.parametrize("name", FAULTS)
def test_faults_of_rings(spark, name):
    rings, fault = FAULTS[name]
    rings = [tuple(rings)] if name == "bow tie" else rings
    many = [(100 + k, [moved(SQUARE, 10 + 3 * k)]) for k in range(4)]
    found = geo.zone_faults(frame(spark, [(7, rings), *many])).collect()
    assert {(r["zone"], r["fault"]) for r in found if r["fault"] != geo.OVERLAP} >= {(7, fault)}
    assert {r["zone"] for r in found} == {7}
    if name != "no area":
        with pytest.raises(ValueError, match=f"zone 7 .*{fault}|{fault}"):
            readers.checked_polygons(frame(spark, [(7, rings), *many]))


OVERLAPS = {
    "corner": [SQUARE, moved(SQUARE, 1, 1)], "half": [SQUARE, moved(SQUARE, 1)], "inner": [SQUARE, moved(small(SQUARE, 0.1), 0.9, 0.9)], "same": [SQUARE, SQUARE], "cross": [([0, 3, 3, 0], [1, 1, 2, 2]), ([1, 2, 2, 1], [0, 0, 3, 3])],
    "far smaller": [small(SQUARE, 500), moved(small(SQUARE, 0.01), 500, 500)], "turned": [([0, 2, 2, 0], [0, 0, 2, 2]), ([2, 2, 0, 0], [2, 0, 0, 2])],
}


@pytest.mark.parametrize("name", OVERLAPS)
def test_overlapping_zones(spark, name):
    zones = frame(spark, [(1, [OVERLAPS[name][0]]), (2, [OVERLAPS[name][1]]), (3, [moved(SQUARE, -9)])])
    assert [(r["zone"], r["fault"], r["other"]) for r in geo.zone_faults(zones).collect()] == [(1, geo.OVERLAP, 2)]
    with pytest.raises(ValueError, match="zone 1 OVERLAPS_ZONE 2"):
        readers.checked_polygons(zones)


def test_sound_zones(spark):
    r = random.Random(2)
    jagged = [0.1 * r.random() for _ in range(400)]
    xs = [k / 399 for k in range(400)]
    # neighbours along a detailed border, one of which has more vertices on it; a hole that touches the outer ring; an island
    finer = sorted([*xs, *[(a + b) / 2 for a, b in zip(xs[::3], xs[1::3], strict=False)]])
    at = lambda x: float(np.interp(x, xs, jagged))
    zones = [
        (1, [([*xs, 1, 0], [*jagged, -1, -1])]), (2, [([*finer, 1, 0], [*map(at, finer), 1, 1])]), (3, [([1, 2, 2, 1], [-1, -1, 1, 1]), ([1.2, 2, 1.2], [-0.5, 0, 0.5])]),
        (4, [([1.3, 1.6, 1.3], [-0.2, 0, 0.2])]), (5, [([2, 3, 3, 2], [-1, -1, 1, 1]), ([5, 6, 6], [5, 5, 6])]),
    ]
    assert geo.zone_faults(frame(spark, zones)).collect() == []
    assert readers.checked_polygons(frame(spark, zones), 5).count() == 5
    with pytest.raises(ValueError, match="1 of them invalid"):
        readers.checked_polygons(frame(spark, [(1, [([0, 1, math.nan], [0, 0, 1])])]))
