"""Outlines and filled terrain beside brute-force versions."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F
from tarnwatch.operators import grid, ledger, outlines, quantiles, scoring, spatial, terrain

WIDTH = 30
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def plain_fill(z, gradient):
    """All cells as one heap."""
    level, heap = {}, []
    for (r, c), v in z.items():
        if v is not None and any(z.get((r + a, c + b)) is None for a, b in EIGHT):
            level[r, c] = v
            heapq.heappush(heap, (v, r, c))
    while heap:
        w, r, c = heapq.heappop(heap)
        if w > level[r, c]:
            continue
        for a, b in EIGHT:
            n = (r + a, c + b)
            if z.get(n) is not None and max(z[n], w + gradient) < level.get(n, math.inf):
                level[n] = max(z[n], w + gradient)
                heapq.heappush(heap, (level[n], *n))
    return {k: level.get(k) for k in z}


@pytest.mark.parametrize("gradient", [0, 1e-4])
@pytest.mark.parametrize("tile", [7, 256])
def test_filled_by_tiles_as_by_one_heap(spark, gradient, tile):
    rng = random.Random(tile)
    z = {(r, c): rng.choice([rng.random() * 9, float(rng.randint(0, 5))]) for r in range(23) for c in range(WIDTH) if rng.random() < 0.99}
    z |= {(r, c): 9.0 if r in (3, 19) or c in (4, 25) else 0.5 for r in range(3, 20) for c in range(4, 26)}  # a pit wider than tiles
    z[15, 25] = 4.0
    z[next(iter(z))] = None
    rows = [(r, c, v) for (r, c), v in z.items()]
    found = terrain.fill_depressions(spark.createDataFrame(rows, "r int, c int, z double").repartition(3), gradient=gradient, tile=tile)
    assert {(r.r, r.c): r.z for r in found.collect()} == plain_fill(z, gradient)


def test_fill_of_nothing(spark):
    none = spark.createDataFrame([], "r int, c int, z double")
    assert terrain.fill_depressions(none).count() == 0 and terrain.fill_depressions(none, gradient=0).count() == 0
    one = spark.createDataFrame([(0, 0, 3.0)], "r int, c int, z double")
    assert terrain.fill_depressions(one, gradient=0).head().z == 3.0 == terrain.fill_depressions(one).head().z


def test_fill_floods_again_only_what_sank(spark, monkeypatch):
    """A long pit open at one end: rounds write borders of tiles only, and go on with the tiles that the water has reached."""
    written = []

    class Watched(terrain.Scratch):
        def cut(self, df, name):
            table = super().cut(df, name)
            written.append((table.count(), table.where("sunk").select("_tr", "_tc").distinct().count() if "sunk" in table.columns else None))
            return table

    monkeypatch.setattr(terrain, "Scratch", Watched)
    z = {(r, c): 0.5 if r == 12 and c < 62 else 9.0 for r in range(24) for c in range(64)}
    found = terrain.fill_depressions(spark.createDataFrame([(*k, v) for k, v in z.items()], "r int, c int, z double"), tile=8)
    assert {(r.r, r.c): r.z for r in found.collect()} == plain_fill(z, 1e-4)
    tables = [n for n, _ in written]
    assert tables[0] == 3 * 8 and max(tables) < len(z) / 2  # a row for each tile, then borders
    sunk = [n for _, n in written if n is not None]
    assert len(sunk) > 8 and sunk[0] == 3 * 8 and max(sunk[2:]) <= 9 and sunk[-1] == 0  # where the water is, and the tiles around


@pytest.mark.parametrize("gradient", [0, 1e-4, 0.3])
def test_fill_along_a_winding_way(spark, gradient):
    """Few cells sink at a time, so the heap takes over from the sweeps; some have no elevation, or an infinite one."""
    way = {(r, c) for r in range(1, 39) for c in range(1, 39) if r % 2 or c == (38 if r % 4 else 1)} | {(1, 0)}
    z = {(r, c): 0.5 if (r, c) in way else 9.0 for r in range(40) for c in range(40)} | {(4, 20): math.inf, (4, 21): math.inf, (17, 17): -1.0}
    z |= {(30, c): None for c in range(20, 22)}
    found = terrain.fill_depressions(spark.createDataFrame([(*k, v) for k, v in z.items()], "r int, c int, z double"), gradient=gradient, tile=64)
    assert {(r.r, r.c): r.z for r in found.collect()} == plain_fill(z, gradient) | {(4, 20): math.inf, (4, 21): math.inf}


def plain_rings(mask):
    """Walks with the region on the right: at each corner right if it can, else straight on, else left."""
    sides = {}
    for r, c in mask:
        for k, ((a, b), start, end) in enumerate((((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r)))):
            if (r + a, c + b) not in mask:
                sides[start, end] = (r * WIDTH + c) * 4 + k
    left, rings = dict(sides), []
    while left:
        (start, end), ring = min(left, key=left.get), []
        side = (start, end)
        while side in left:
            ring.append(side)
            del left[side]
            (x, y), (u, v) = side
            dx, dy = u - x, v - y
            side = next(s for s in (((u, v), (u - dy, v + dx)), ((u, v), (u + dx, v + dy)), ((u, v), (u + dy, v - dx))) if s in sides)
        corners = [s[0] for i, s in enumerate(ring) if (s[1][0] - s[0][0], s[1][1] - s[0][1]) != (ring[i - 1][1][0] - ring[i - 1][0][0], ring[i - 1][1][1] - ring[i - 1][0][1])]
        rings.append(corners)
    return rings


def turned(ring):
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


def rings_of(df):
    rings = {}
    for r in df.orderBy("ring", "seq").collect():
        rings.setdefault(r.ring, []).append((r.x, r.y))
    return rings


def test_rings_of_masks_with_holes(spark):
    rng = random.Random(2)
    mask = {(r, c) for r in range(14) for c in range(WIDTH) if rng.random() < 0.62}
    mask |= {(r, c) for r in range(16, 26) for c in range(2, 28)}
    mask -= {(18, 5), (19, 5), (19, 6), (20, 7), (22, 20), (23, 21)}  # holes, two of which touch at corners
    df = spark.createDataFrame(sorted(mask), "r int, c int").repartition(3)
    found = outlines.ring_corners(df, WIDTH).cache()
    assert sorted(turned(r) for r in rings_of(found).values()) == sorted(turned(r) for r in plain_rings(mask))
    measures = outlines.ring_measures(found).collect()
    assert sum(m.area for m in measures) == len(mask)
    assert outlines.ring_corners(df.where("r < 0"), WIDTH).count() == 0
    outer = [(r.x, r.y) for r in outlines.change_polygon(df, WIDTH, x0=100, y0=50, step=2).orderBy("seq").collect()]
    largest = outlines.largest_region(outlines.label_components(df, WIDTH)).head()
    area = sum(x * v - u * y for (x, y), (u, v) in zip(outer, outer[1:] + outer[:1], strict=True)) / 2
    assert min((50 - y) / 2 for _, y in outer) == largest.r_min and abs(area) / 4 >= largest.cells


def plain_simplified(ring, tolerance):
    def off(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])

    def split(i, j):
        inner = range(i + 1, j)
        if not inner:
            return []
        k = max(inner, key=lambda k: (off(ring[k], ring[i], ring[j % len(ring)]), -k))
        return [*split(i, k), k, *split(k, j)] if off(ring[k], ring[i], ring[j % len(ring)]) > tolerance else []

    m = max(range(len(ring)), key=lambda k: ((ring[k][0] - ring[0][0]) ** 2 + (ring[k][1] - ring[0][1]) ** 2, -k))
    return [ring[k] for k in sorted({0, *split(0, m), m, *split(m, len(ring))})]


@pytest.mark.parametrize("tolerance", [0.8, 2.5])
def test_simplified_rings(spark, tolerance):
    rng = random.Random(11)
    rows = []
    for ring in range(3):
        for k in range(40 + ring):
            a = 2 * math.pi * k / (40 + ring)
            rows.append((ring, k, 20 * math.cos(a) + rng.random() * 3, 20 * math.sin(a) + rng.random() * 3))
    rows.append((9, 0, 1.0, 1.0))
    found = rings_of(outlines.simplified(spark.createDataFrame(rows, "ring long, seq long, x double, y double"), tolerance))
    for ring in (0, 1, 2, 9):
        assert found[ring] == plain_simplified([(x, y) for i, _, x, y in rows if i == ring], tolerance)


def star(rng, x, y, size, corners):
    angles = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    return [(x + size * (0.3 + rng.random()) * math.cos(a), y + size * (0.3 + rng.random()) * math.sin(a)) for a in angles]


def is_inside(x, y, edges):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2 == 1


def test_points_in_a_thousand_polygons_of_one_band(spark):
    rng = random.Random(21)
    shapes = {k: [star(rng, k * 0.4 - 200, 27 + rng.random(), 0.5, rng.randint(3, 9))] for k in range(1000)}
    shapes[1000] = [star(rng, -100, 20, 60, 40), [(-101, 19), (-99, 19), (-99, 21), (-101, 21)]]  # a wide one with a hole
    shapes[1001] = [[(0, 0), (40, 0), (40, 0.001), (0, 0.001)], [(-3, -9), (-3, 40), (-2.9, 40), (-2.9, -9)]]
    edges = {k: [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)] for k, rings in shapes.items()}
    points = [(i, rng.uniform(-210, 210), rng.choice([27.5, rng.uniform(-10, 60), 0.0005])) for i in range(1500)]
    boxes = {k: (min(min(e[0], e[2]) for e in of), max(max(e[0], e[2]) for e in of)) for k, of in edges.items()}
    expected = {(i, k) for i, x, y in points for k, of in edges.items() if boxes[k][0] <= x <= boxes[k][1] and is_inside(x, y, of)}
    table = spark.createDataFrame([(k, *map(float, e)) for k, of in edges.items() for e in of], "poly int, x1 double, y1 double, x2 double, y2 double")
    places = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points], "id int, x double, y double")
    for cell in (0.25, 2.0):
        assert {(r.id, r.poly) for r in spatial.polygon_parity(places, table, cell).collect()} == expected
    coarse, fine, border = spatial.polygon_cover(table, 0.25)
    assert not coarse.isEmpty() and not fine.isEmpty()
    assert spatial.polygon_parity(places, table.where("poly < 0")).count() == 0
    hot = border.groupBy("_r", "_c").count().agg({"count": "max"}).head()[0]
    assert hot < 100  # no square is the key of a large part of all edges


def test_quantiles_of_skewed_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 5)
    rng = random.Random(8)
    rows = [("all", rng.choice([rng.gauss(0, 1e6), rng.random(), 7.0, -1e300, 1e300]), float(k % 3)) for k in range(3000)]
    rows += [("few", 2.0, None), ("few", 3.0, None), ("none", None, 1.0), (None, 4.0, 5.0), (None, float("nan"), 6.0), ("one", 0.1, 0.1)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    levels = [0.0, 0.05, 0.5, 0.9, 1.0]
    found = {r.k: (r.x, r.y) for r in quantiles.grouped_quantiles(df, ["k"], {"x": "a", "y": F.col("b") * 2}, levels).collect()}
    clean = df.withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    want = clean.groupBy("k").agg(F.percentile("a", F.array(*[F.lit(q) for q in levels])).alias("x"), F.percentile(F.col("b") * 2, F.array(*[F.lit(q) for q in levels])).alias("y"))
    assert found == {r.k: (r.x, r.y) for r in want.collect()}
    whole = quantiles.grouped_quantiles(df.where("k = 'all'"), [], {"x": "a"}, [0.25]).head().x
    assert whole == df.where("k = 'all'").agg(F.percentile("a", F.array(F.lit(0.25)))).head()[0]
    assert quantiles.grouped_quantiles(df.where("k = '-'"), ["k"], {"x": "a"}, [0.5]).count() == 0


def test_a_surface_that_rises_to_the_north_leans_south(spark):
    """Rows go south: z falls with the row, at 45 degrees."""
    df = spark.createDataFrame([(r, c, 30.0 * (4 - r)) for r in range(5) for c in range(5)], "r int, c int, z double")
    s = grid.slope_degrees(df, 30.0)
    north, south = (grid.local_incidence_cos(F.col("nx"), F.col("ny"), F.col("nz"), 45.0, a) for a in (0.0, 180.0))
    for r in s.select("nx", "ny", "nz", "slope", north.alias("from_north"), south.alias("from_south")).collect():
        assert (r.nx, r.slope) == (0.0, pytest.approx(45)) and r.ny == pytest.approx(-math.sqrt(0.5)) and r.nz == pytest.approx(math.sqrt(0.5))
        assert r.from_north == pytest.approx(0, abs=1e-12) and r.from_south == pytest.approx(1)


def test_sectors_by_hand(spark):
    rows = [
        (1, 11, 1, "village", 400, 30.0, 100.0, False), (1, 12, 2, "village", 900, 50.0, 100.0, False), (1, 13, 3, "settlement", 5000, 40.0, 100.0, False), (1, 14, 4, "village", 100, None, 100.0, False),
        (1, 20, 5, "well", None, 40.0, 100.0, True), (1, 21, 6, "well", 70, 1.0, 100.0, False), (1, 22, 7, "well", 0, None, 100.0, False), (1, 23, 8, "well", 0, 9000.0, 100.0, False),
        (1, 30, 9, "road", None, 10.0, 50.0, True), (2, 40, 1, "well", 60, 5.0, 100.0, False),
    ]
    e = spark.createDataFrame(rows, "run_id long, asset_id long, line int, asset_type string, population long, distance_m double, buffer_m double, inundated boolean").repartition(3)
    # 20 lies between both villages: the first line; 22 has no distance: the smallest; 23 is nearest to the one without
    assert {r.well: r.served for r in scoring.served_population(e).collect()} == {20: 400, 21: 70, 22: 100, 23: 100, 40: 0}
    roll = {r.run_id: r for r in scoring.exposure_rollup(e, default_population=1240).collect()}
    assert (roll[1].population, roll[1].settlements, roll[2].population) == (5000, 4, 1240)
    ranked = ledger.rank_sectors(scoring.rescue_sectors(e)).where("run_id = 1").orderBy("rank").collect()
    assert [(r.sector, r.population) for r in ranked] == [("village-12-2", 900), ("access-routes", 1400), ("water-points", 670), ("village-11-1", 400), ("village-14-4", 100)]
    same = scoring.rescue_sectors(e.withColumn("population", F.lit(0)))
    assert [r.sector for r in ledger.rank_sectors(same).where("run_id = 1").orderBy("rank").collect()] == ["village-11-1", "village-12-2", "village-14-4", "water-points", "access-routes"]
