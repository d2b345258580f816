"""The outline of a corridor and what it exposes, beside places sampled along all candidates."""

import math
import random

import pytest
from tarnwatch.operators import corridor

R = 125.0


def to_segment(p, e):
    (x, y), (x1, y1, x2, y2) = p, e
    dx, dy = x2 - x1, y2 - y1
    q = dx * dx + dy * dy
    t = max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / q)) if q else 0
    return math.hypot(x1 + t * dx - x, y1 + t * dy - y)


def bank(edges, step=0.5):
    """Places of all sides and circles that are nearer than the radius to no edge."""
    places = []
    for x1, y1, x2, y2 in edges:
        w = math.hypot(x2 - x1, y2 - y1)
        for k in range(int(w / step) + 1):
            t = k * step / w if w else 0
            places += [(x1 + t * (x2 - x1) - s * (y2 - y1) / w, y1 + t * (y2 - y1) + s * (x2 - x1) / w) for s in (R, -R) if w]
        n = int(2 * math.pi * R / step)
        places += [(x + R * math.cos(2 * math.pi * k / n), y + R * math.sin(2 * math.pi * k / n)) for x, y in ((x1, y1), (x2, y2)) for k in range(n)]
    return [p for p in places if all(to_segment(p, e) > R - 1e-6 for e in edges)]


def inside(p, ring):
    return sum((y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in ring) % 2 == 1


def dots(edges, step=1.0):
    for x1, y1, x2, y2 in edges:
        n = int(math.hypot(x2 - x1, y2 - y1) / step) + 1
        yield from ((x1 + k / n * (x2 - x1), y1 + k / n * (y2 - y1)) for k in range(n + 1))


def ring(*corners):
    return [(*map(float, a), *map(float, b)) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]


CROSSING = [(0, 0, 1000, 0), (500, -500, 500, 500), (1000, 0, 1300, 90), (1300, 90, 1300, 90)]
LOOP = [(0, 0, 400, 0), (400, 0, 400, 400), (400, 400, 0, 400), (0, 400, 0, 0), (0, 400, 400, 400), (180, 0, 180, 10)]  # a hole, an edge twice, a spur within
BENDS = [(0, 0, 60, 10), (60, 10, 100, 70), (100, 70, 90, 140), (90, 140, 220, 150), (220, 150, 500, 150), (500, 150, 800, 150)]
ISLAND = [(0, 0, 300, 0), (900, 40, 950, 900)]


@pytest.mark.parametrize("edges", [CROSSING, LOOP, BENDS, ISLAND], ids=["crossing", "loop", "bends", "island"])
def test_outline_and_exposures(spark, edges):
    rng = random.Random(len(edges))
    edges = [tuple(map(float, e)) for e in edges]
    assets = {}
    for i in range(60):
        x, y = rng.uniform(-300, 1500), rng.uniform(-600, 700)
        if i < 25:
            x, y = rng.choice(list(dots(edges, 10)))
            x, y = x + rng.uniform(-100, 100), y + rng.uniform(-100, 100)
        if i % 3 == 0:
            assets[i] = ([(x, y, x, y)], False, 50.0)
        elif i % 3 == 1:
            a = rng.random() * 7
            assets[i] = ([(x, y, x + 60 * math.cos(a), y + 60 * math.sin(a)), (x + 60 * math.cos(a), y + 60 * math.sin(a), x + 80, y - 20)], False, 75.0)
        else:
            s = rng.choice([10, 40, 300])
            assets[i] = (ring((x, y), (x + s, y), (x + s / 2, y + s)), True, 100.0)
    assets[100] = (ring((-900, -900), (2900, -900), (2900, 2900), (-900, 2900)), True, 50.0)  # holds all of the corridor
    assets[101] = (ring((150, 150), (250, 150), (250, 250), (150, 250)), True, 50.0)
    places, expected = bank(edges), {}
    for i, (own, filled, tolerance) in assets.items():
        holds = lambda p, own=own, filled=filled: filled and inside(p, own)
        d = min(min(to_segment(p, e) for p in dots(own) for e in edges), min(to_segment(p, s) for e in edges for p in (e[:2], e[2:]) for s in own))
        d = 0.0 if any(holds(e[:2]) for e in edges) else d
        crossed = any(holds(p) for p in places)
        away = 0.0 if crossed else min(to_segment(p, s) for p in places for s in own)
        expected[i] = (d, away, tolerance)
    rows = [(i, *map(float, s), filled, tolerance) for i, (own, filled, tolerance) in assets.items() for s in own]
    shapes = spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double, filled boolean, tolerance_m double")
    rivers = spark.createDataFrame([(1, *e) for e in edges], "river int, x1 double, y1 double, x2 double, y2 double")
    outline = corridor.corridor_outline(rivers, R)
    on = [(r.x1, r.y1) for r in outline.collect()] + [(r.x2, r.y2) for r in outline.collect()]
    assert all(abs(min(to_segment(p, e) for e in edges) - R) < 1e-3 for p in on)
    found = {r.id: r for r in corridor.exposure_corridor(rivers.drop("river"), rivers, shapes).collect()}
    for i, (d, away, tolerance) in expected.items():
        if abs(d - R - tolerance) > 0.5:
            assert (i in found) == (d <= R + tolerance), i
        if i in found:
            assert found[i].distance_m == pytest.approx(away, abs=0.6), i
            assert abs(d - R) < 0.5 or found[i].inside == (d <= R), i
    assert found[100].distance_m == 0 and found[100].inside


def test_corridor_of_nothing(spark):
    none = spark.createDataFrame([], "river int, x1 double, y1 double, x2 double, y2 double")
    one = spark.createDataFrame([(1, 5.0, 5.0, 50.0)], "id int, x double, y double, tolerance_m double")
    assert corridor.corridor_outline(none, R).count() == 0 == corridor.exposure_corridor(none.drop("river"), none, one).count()
    dot = spark.createDataFrame([(5.0, 5.0, 5.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    row = corridor.exposure_corridor(dot, none, one).head()
    assert row.inside and row.distance_m == R
