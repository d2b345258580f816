"""Rows that repeat a date or a place: results beside plain versions, and joins that do not grow with the square of the copies."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F
from tarnwatch.operators import corridor, grid, scoring, spatial

DAY = datetime.date(2024, 1, 1)


def most_rows(df):
    """The most rows that any join, generator or window of the executed plan gave."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            left.append(node.plan())
        found = node.metrics().get("numOutputRows")
        if found.isDefined() and ("Join" in name or "Generate" in name or "Window" in name):
            most = max(most, found.get().value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.fixture(scope="module")
def dated(spark):
    r = random.Random(5)
    wanted = [(i, DAY + datetime.timedelta(days=i % 12)) for i in range(300)] + [(900, None), (901, DAY + datetime.timedelta(days=400))]
    scenes = [(i, r.randrange(5) / 10, DAY + datetime.timedelta(days=r.randrange(25))) for i in range(3000)] + [(9000, 0.0, None)]
    return wanted, scenes, spark.createDataFrame(wanted, "want_id int, day date"), spark.createDataFrame(scenes, "scene_id int, cloud double, taken date")


def test_candidates_of_repeated_dates(dated):
    wanted, scenes, w, s = dated
    df = spatial.scene_date_candidates(w, s)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.want_id, r.rank)):
        got.setdefault(r.want_id, []).append((r.cloud, r.off, r.scene_id))
    for i, day in wanted:
        near = sorted((c, abs((t - day).days), k) for k, c, t in scenes if day and t and abs((t - day).days) <= 7)[:6]
        assert got.get(i, []) == near
    assert most_rows(df) < 4000  # dates with their scenes by pairs are half a million


def test_status_of_repeated_dates(dated):
    wanted, scenes, w, s = dated
    df = spatial.scene_date_status(w, spatial.scene_date_candidates(w, s), most_cloud=0.1)
    got = {r.want_id: r for r in df.collect()}
    assert len(got) == 302 and {got[i].status for i in (900, 901)} == {"no_scenes"} and got[901].fallbacks == 0 and got[901].clear is None
    assert all(got[i].fallbacks == 5 and got[i].clear and got[i].cloud == 0 for i in range(300))
    assert most_rows(df) < 4000


def test_pair_of_days_with_many_scenes(spark):
    r = random.Random(6)
    rows = [(k, i, DAY + datetime.timedelta(days=r.choice((0, 1, 9, 14, 40)))) for k in range(2) for i in range(500)] + [(0, 1, None)]
    df = spatial.scene_pair_pick(spark.createDataFrame(rows, "key int, scene_id int, taken date"), "key", 12, 30)
    for row in df.collect():
        own = [(i, t) for k, i, t in rows if k == row.key and t]
        best = min((abs((u - t).days - 12), t, u, i, j) for i, t in own for j, u in own if 0 < (u - t).days <= 30)
        assert (row.off, row.first, row.second) == (best[0], best[3], best[4])
    assert most_rows(df) < 100  # pairs of scenes are a hundred thousand


def test_a_well_listed_twice_is_one_row(spark):
    rows = [(1, 11, 1, "village", 400, 30.0), (1, 12, 2, "village", 900, 50.0), (1, 20, 5, "well", 0, 44.0), (1, 20, 5, "well", 0, 31.0), (1, 21, 6, "well", 0, 49.0), (1, 21, 6, "well", 80, 31.0)]
    e = spark.createDataFrame(rows, "run_id long, asset_id long, line int, asset_type string, population long, distance_m double").repartition(2)
    assert sorted((r.well, r.line, r.served) for r in scoring.served_population(e).collect()) == [(20, 5, 400), (21, 6, 80)]


def test_own_bank_of_a_point_below_two_corridors(spark):
    rivers = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0), (2, 0.0, 100.0, 1000.0, 100.0)], "river int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 500.0, 10.0, 50.0), (2, 500.0, 250.0, 50.0), (3, 500.0, 300.0, 50.0)], "id int, x double, y double, tolerance_m double")
    found = {own: {r.id: (r.distance_m, r.inside) for r in corridor.exposure_corridor(rivers.drop("river"), rivers, points, own_bank=own).collect()} for own in (True, False)}
    assert found[True] == {1: (115.0, True), 2: (25.0, False)}
    assert found[False] == {1: (135.0, True), 2: (25.0, False)}
    with pytest.raises(ValueError):
        corridor.exposure_corridor(rivers.drop("river"), rivers, points.selectExpr("id", "x AS x1", "y AS y1", "x AS x2", "y AS y2", "false AS filled", "tolerance_m"), own_bank=True)


def test_corridor_of_copies(spark):
    r = random.Random(11)
    lines = [[(100.0 * k, 50.0 * k, 100.0 * k + 300, 50.0 * k + 80), (100.0 * k + 300, 50.0 * k + 80, 900.0, 2000.0)] for k in range(3)] + [[(5000.0, 5000.0, 5200.0, 5000.0)]]
    rivers = [(k, *e) for k in range(160) for e in lines[k % 4]]
    spots = [(r.uniform(0, 600), r.uniform(-200, 400)) for _ in range(20)] + [(r.uniform(-300, 1300), r.uniform(-300, 2200)) for _ in range(8)] + [(150.0, 50.0), (5100.0, 5010.0)]
    rows = [(i, *spots[i % 30], 50.0 + i % 2 * 25) for i in range(600)] + [(0, *spots[28], 50.0)]  # the first has two places
    away = lambda x, y, e: math.dist((x, y), (e[0] + (t := max(0.0, min(1.0, ((x - e[0]) * (e[2] - e[0]) + (y - e[1]) * (e[3] - e[1])) / math.dist(e[:2], e[2:]) ** 2))) * (e[2] - e[0]), e[1] + t * (e[3] - e[1])))
    nearest = {}
    for i, x, y, tolerance in rows:  # the last line is too far from the path
        nearest[i, tolerance] = min(nearest.get((i, tolerance), math.inf), *[away(x, y, e) for line in lines[:3] for e in line])
    expected = {k: (round(abs(d - 125), 1), d <= 125) for k, d in nearest.items() if d <= 125 + k[1]}
    named = lambda rows, schema: spark.createDataFrame(rows, schema)
    df = corridor.exposure_corridor(named([(0.0, -100.0, 200.0, -100.0)] * 40, "x1 double, y1 double, x2 double, y2 double"), named(rivers, "river int, x1 double, y1 double, x2 double, y2 double"), named(rows, "id int, x double, y double, tolerance_m double"), own_bank=True)
    got = {(p.id, p.tolerance_m): (p.distance_m, p.inside) for p in df.collect()}
    assert got.keys() == expected.keys() and len(got) > 200
    assert all(got[k][1] == v[1] and got[k][0] == pytest.approx(v[0], abs=0.11) for k, v in expected.items())
    assert most_rows(df) < 8000  # 30 places meet 6 edges; assets and edges are 72,000 pairs


def test_copies_of_places_and_shapes(spark):
    r = random.Random(7)
    spots = [(r.randrange(20) / 4, r.randrange(20) / 4) for _ in range(15)]
    points = spark.createDataFrame([(i, *spots[i % 15]) for i in range(600)], "id int, x double, y double")
    ring = lambda k, x, y: [(k, x, y, x + 1.1, y), (k, x + 1.1, y, x + 1.1, y + 0.7), (k, x + 1.1, y + 0.7, x, y + 0.7), (k, x, y + 0.7, x, y)]
    corners = [(x - 0.3, y - 0.2) for x, y in spots[:4]]
    edges = spark.createDataFrame([e for k in range(80) for e in ring(k, *corners[k % 4])], "poly int, x1 double, y1 double, x2 double, y2 double")
    inside = {(i, k) for i in range(600) for k in range(80) for (x, y), (w, s) in [(spots[i % 15], corners[k % 4])] if w <= x < w + 1.1 and s <= y < s + 0.7}
    assert sorted((p.id, p.poly) for p in spatial.polygon_parity(points, edges).collect()) == sorted(inside)
    far = {p.id: p.distance for p in corridor.nearest_polygon_distance(points, edges, 0.25).collect()}
    for i, (x, y) in ((i, spots[i % 15]) for i in range(600)):
        assert far[i] == pytest.approx(min(math.hypot(max(w - x, 0, x - w - 1.1), max(s - y, 0, y - s - 0.7)) for w, s in corners))
    df = corridor.area_within_radius(points, edges, 9.0)  # the disc holds all
    assert {round(p.area, 6) for p in df.collect()} == {round(80 * 1.1 * 0.7, 6)}
    assert most_rows(df) < 6000  # 15 places meet 320 edges; points and edges are 192,000 pairs
    nowhere = points.union(spark.createDataFrame([(900, None, 1.0)], points.schema))
    assert {p.id: p.distance for p in corridor.nearest_polygon_distance(nowhere, edges, 0.25).collect()}[900] is None


def test_clusters_of_copies_follow_the_sequential_rule(spark):
    r = random.Random(8)
    spots = [(30 + r.randrange(10) / 50, 80 + r.randrange(10) / 50) for _ in range(40)]
    rows = [(i, *spots[r.randrange(40)]) for i in range(400)] + [(500, None, 80.0), (501, None, 80.0)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    near = {(a.id, a.other) for a in spatial.pairs_within(points, points, 3.0).collect()}
    centres, expected = [], {}
    for i, *_ in rows:
        expected[i] = next((c for c in centres if (i, c) in near), i)
        if expected[i] == i:
            centres.append(i)
    assert {p.id: p.centre for p in spatial.greedy_radius_clusters(points, 3.0).collect()} == expected


def test_lines_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(grid, "STRETCH", 5)
    r = random.Random(9)
    z = {(i, j): float(r.randrange(50)) for i in range(-7, 17) for j in range(13) if r.random() < 0.9}
    cells = spark.createDataFrame([(*k, v) for k, v in z.items()], "r long, c long, z double")
    got = grid.with_neighbours(cells).collect()
    assert len(got) == len(z)
    steps = {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}
    assert all(g[k] == z.get((g.r + a, g.c + b)) for g in got for k, (a, b) in steps.items())
    mask = {k for k, v in z.items() if v < 46}
    opened = {(i + a, j + b) for i, j in mask if all((i + a, j + b) in mask for a in (-1, 0, 1) for b in (-1, 0, 1)) for a in (-1, 0, 1) for b in (-1, 0, 1)}
    assert opened and {(p.r, p.c) for p in grid.open_mask(cells.where("z < 46"), 1).collect()} == opened
