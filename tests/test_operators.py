"""Operators on small frames with answers worked out by hand, and against plain Python."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tarnwatch.functions import scalars as S
from tarnwatch.operators import corridor, evaluation, grid, lakes, learning, ledger, scoring, spatial, terrain, weather
from tarnwatch.operators.graph import connected
from tarnwatch.scratch import Scratch
from tarnwatch.streaming import jobs


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_quality_gate_boundaries(spark):
    df = spark.createDataFrame([(1, 0.19, 0.99, "s2"), (2, 0.20, 1.0, "s2-nrt"), (3, 0.9, 0.5, "Sentinel-1"), (4, -1.0, 5.0, "s2")], "id int, cloud double, shift double, sensor string")
    out = {r.id: r.q for r in df.select("id", S.quality_gate(F.col("cloud"), F.col("shift"), F.col("sensor")).alias("q")).collect()}
    assert out[1].usable and out[1].alignment_ok and not out[2].usable and not out[2].alignment_ok
    assert out[3].cloud == 0 and out[3].usable and out[4].cloud == 0
    assert abs(out[2].confidence - 0.8) < 1e-12


def test_rain_by_rows_and_by_days_differ_on_a_missing_day(spark):
    days = [(1, f"2024-01-0{d}", float(d)) for d in (1, 2, 3, 5, 6, 7, 8, 9)]
    w = spark.createDataFrame(days, "station int, day string, precip double").withColumn("day", F.to_date("day"))
    rows = {str(r.day): r.rain_7d for r in weather.antecedent_rain_rows(w).collect()}
    cal = {str(r.day): (r.rain_7d, r.missing) for r in weather.antecedent_rain_days(w).collect()}
    assert rows["2024-01-09"] == 2 + 3 + 5 + 6 + 7 + 8 + 9 and cal["2024-01-09"] == (3 + 5 + 6 + 7 + 8 + 9, 1)


def test_windows_with_too_many_nulls_are_dropped(spark):
    w = spark.range(30).select(F.lit(1).alias("station"), F.date_add(F.to_date(F.lit("2024-01-01")), F.col("id").cast("int")).alias("day"), F.when(F.col("id") > 4, 1.0).alias("precip"), F.lit(1.0).alias("tmean"), F.lit(0.0).alias("tmin"), F.lit(2.0).alias("tmax"), F.lit(0.0).alias("station_elev"))
    e = spark.createDataFrame([(1, 1, 0.0)], "event_id int, station int, elev_m double").withColumn("event_date", F.to_date(F.lit("2024-01-30")))
    assert weather.event_windows(e, w).count() == 0
    assert weather.event_windows(e, w, most_nulls=5).first().rain_30d == 25


def test_severity_rules(spark):
    df = spark.createDataFrame([(0.7, 501, 0, 0.0), (0.7, 500, 0, 0.0), (0.1, 0, 0, 40.0), (0.3, 0, 0, 0.0), (0.29, 0, 0, 0.0)], "h double, p int, a int, e double")
    assert [r.s for r in df.select(scoring.severity(F.col("h"), F.col("p"), F.col("a"), F.col("e")).alias("s")).collect()] == ["critical", "elevated", "critical", "watch", "informational"]


def test_later_reject_overrides_confirm(spark):
    r = spark.createDataFrame([(1, 1, "confirm", 1), (1, 2, "reject", 1), (2, 3, "confirm", 5)], "run_id int, review_id int, decision string, decided_at int")
    assert values(ledger.latest_review(r), "run_id", "confirmed") == [(1, False), (2, True)]


def test_hash_chain_round_trip_and_break(spark):
    e = spark.createDataFrame([("a", i, f"t{i}", f"d{i}") for i in range(5)], "k string, entry_id long, created_at string, detail string")
    chained = ledger.build_chain(e, "k")
    prev = "0" * 64
    for r in chained.orderBy("entry_id").collect():
        assert r.prev_hash == prev
        prev = hashlib.sha256(f"{prev}{r.created_at}{r.detail}".encode()).hexdigest()
        assert r.event_hash == prev
    broken = chained.withColumn("detail", F.when(F.col("entry_id") == 3, "x").otherwise(F.col("detail")))
    assert values(ledger.verify_chain(broken, "k"), "valid", "first_break") == [(False, 3)]


def test_payload_round_trip(spark):
    runs = spark.createDataFrame([(1, "b", "glof", "critical", 5, ["r1"], []), (2, "b", "glof", "odd", 5, [], [])], "run_id int, geofence string, hazard string, severity string, population long, routes array<string>, flags array<string>")
    out = ledger.alert_payload(runs)
    assert values(out, "run_id", "error") == [(1, None), (2, "unknown severity")]
    assert ledger.decode_payload(out.where("error IS NULL")).first().severity == "critical"


def random_grid(spark, n, seed):
    rng = random.Random(seed)
    z = {(r, c): float(rng.randint(0, 60)) for r in range(n) for c in range(n)}
    return z, spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "r long, c long, z double")


def test_flow_against_sequential_walk(spark):
    z, df = random_grid(spark, 12, 4)
    flow = terrain.d8_direction(df)
    to = {(r.r, r.c): None if r.to_r is None else (r.to_r, r.to_c) for r in flow.collect()}
    acc = dict.fromkeys(z, 0)
    for cell in z:
        while cell is not None:
            acc[cell] += 1
            cell = to[cell]
    found = terrain.flow_accumulation(flow, 12)
    assert {(r.r, r.c): r.acc for r in found.collect()} == acc
    for r in terrain.hand(flow, found, 12, 4).collect():
        cell = (r.r, r.c)
        while cell is not None and acc[cell] < 4:
            cell = to[cell]
        assert r.hand == (0 if cell is None else max(0, z[(r.r, r.c)] - z[cell]))


def test_filled_grid_has_no_pits_inside(spark):
    _, df = random_grid(spark, 8, 2)
    filled = terrain.fill_depressions(df)
    pits = terrain.d8_direction(filled).where("code = 0 AND r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6")
    assert pits.count() == 0
    assert terrain.fill_depressions(df, mode="none") is df


def test_components_on_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)]
    random.Random(1).shuffle(edges)
    roots = connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {r.node: r.root for r in roots.collect()} == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_dilate_erode(spark):
    one = spark.createDataFrame([(5, 5)], "r long, c long")
    assert grid.dilate(one).count() == 5 and grid.dilate(one, 2).count() == 13
    assert values(grid.erode(grid.dilate(one)), "r", "c") == [(5, 5)]


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 0), (1, 0.9, 1), (1, 0.1, 0)], "k int, score double, label int")
    assert evaluation.rank_auc(rows, ["k"]).first().auc == 0.875


def test_single_class_has_no_auc(spark):
    rows = spark.createDataFrame([(1, 0.5, 1)], "k int, score double, label int")
    assert evaluation.rank_auc(rows, ["k"]).first().auc is None


def test_results_do_not_depend_on_partitions(spark, sf):
    from tarnwatch.plans import standins

    e = standins.exposures(spark, sf)
    a = values(scoring.exposure_rollup(e.repartition(7)), "run_id", "population", "access_loss")
    assert a == values(scoring.exposure_rollup(e.coalesce(1)), "run_id", "population", "access_loss")


def test_a_long_chain_of_points_is_clustered_in_order(spark):
    points = spark.range(500).select("id", F.lit(30.0).alias("lat"), (80 + F.col("id") * 0.01).alias("lon"))
    found = {r.id: r.centre for r in spatial.greedy_radius_clusters(points, 1.5).collect()}
    centres, expected = [], {}
    for i in range(500):
        near = [c for c in centres if (i - c) * 0.01 * 111.195 * 0.866 <= 1.5]
        expected[i] = near[0] if near else i
        centres += [] if near else [i]
    assert found == expected


def test_holes_are_filled_and_bays_are_not(spark):
    ring = [(r, c) for r in range(2, 7) for c in range(2, 7) if r in (2, 6) or c in (2, 6)]
    bay = [(r, c) for r, c in ring if (r, c) != (4, 6)]
    df = lambda cells: spark.createDataFrame(cells, "r long, c long")
    assert grid.fill_holes(df(ring), 10, 10).count() == 25
    assert grid.fill_holes(df(bay), 10, 10).count() == len(bay)


def test_drawdown_of_a_flat_lake(spark):
    cells = [(r, c, 5200.0 if 10 <= r < 30 and 10 <= c < 30 else 5300.0 + 9 * (r * 7 % 11) + 5 * c, 0.0) for r in range(40) for c in range(40)]
    cells = [(r, c, z, z - 12.0 if z == 5200.0 else z) for r, c, z, _ in cells]
    out = lakes.lake_drawdown(spark.createDataFrame(cells, "r long, c long, before double, after double"), 40, (5190.0, 5210.0), (5180.0, 5210.0), 4.0).first()
    flat = sum(all(10 <= r + i < 30 and 10 <= c + j < 30 for i in range(-4, 5) for j in range(-4, 5)) for r in range(40) for c in range(40))
    assert out.area_before_m2 == 4.0 * flat and out.drawdown_m == 12.0 and out.emptied_m3 == 12.0 * 4.0 * flat


def test_breach_errors(spark):
    lake = lambda k, z: [(k, r, c, z(r, c)) for r in range(5) for c in range(5)]
    rows = lake("dry", lambda r, c: 9.0) + lake("full", lambda r, c: 1.0) + lake("pit", lambda r, c: 1.0 if 1 <= r <= 3 and 1 <= c <= 3 else 9.0)
    cells = spark.createDataFrame(rows, "lake string, r long, c long, z double")
    out = {r.lake: r for r in lakes.breach_volume(cells, ["lake"], F.col("z") < 5, F.lit(False), 10.0).collect()}
    assert (out["dry"].error, out["full"].error) == ("no water before", "no rim before")
    assert (out["pit"].volume_m3, out["pit"].method, out["pit"].mode) == (9 * 8 * 10.0, "hypsometric", "observed_drainage")


def test_part_of_a_disc(spark):
    square = [("s", -9.0, -9.0, 9.0, -9.0), ("s", 9.0, -9.0, 9.0, 9.0), ("s", 9.0, 9.0, -9.0, 9.0), ("s", -9.0, 9.0, -9.0, -9.0)]
    edges = spark.createDataFrame(square, "poly string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0), (3, 9.0, 9.0), (4, 30.0, 0.0)], "id int, x double, y double")
    area = {r.id: r.area for r in corridor.area_within_radius(points, edges, 2.0).collect()}
    whole = 3.141592653589793 * 4
    assert all(abs(area[i] - part * whole) < 1e-9 for i, part in ((1, 1), (2, 0.5), (3, 0.25), (4, 0)))
    assert {r.id: r.distance for r in corridor.nearest_polygon_distance(points, edges, 1.0).collect()}[4] == 21.0


def scenes(spark, rows, path):
    spark.createDataFrame(rows, "source string, scene_id string, taken string, href string").withColumn("taken", F.col("taken").cast("timestamp")).coalesce(1).write.mode("append").json(path)


def test_streams_register_once_and_score_new_rows(spark, tmp_path):
    landed, ledger_path, marks = (str(tmp_path / n) for n in ("landed", "ledger", "marks"))
    schema = "source string, scene_id string, taken timestamp, href string"
    run = lambda mark: jobs.register_scenes(spark.readStream.schema(schema).json(landed), ledger_path, f"{marks}-{mark}").awaitTermination()
    scenes(spark, [("s1", "a", "2024-01-01", "x"), ("s1", "a", "2024-01-01", "x"), ("s1", "b", "2024-01-02", "y"), ("s1", None, "2024-01-02", "z")], landed)
    run("first")
    scenes(spark, [("s1", "b", "2024-01-02", "y"), ("s2", "a", "2024-02-20", "w"), ("s1", "old", "2023-01-01", "late")], landed)
    run("first")
    table = lambda: sorted((r.source, r.scene_id) for r in spark.read.parquet(ledger_path).collect())
    assert ("s1", "a") in table() and len(table()) == len(set(table())) and {("s1", "b"), ("s2", "a")} <= set(table())
    before = table()
    run("again")  # a new checkpoint reads all files once more
    assert set(table()) == set(before) | {("s1", "old")} and len(table()) == len(set(table()))

    out = str(tmp_path / "scored")
    score = lambda df: df.where("scene_id IS NOT NULL").select("scene_id", F.length("href").alias("score"))
    for _ in range(2):
        jobs.score_stream(spark.readStream.schema(schema).json(landed), score, out, f"{marks}-scores").awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_stream_of_job_states_over_three_runs(spark, tmp_path):
    landed, out, marks = (str(tmp_path / n) for n in ("landed", "jobs", "marks"))
    schema = "job_id string, seq int, status string, error string, path string"
    batches = [
        [("a", 1, "pending", None, None), ("b", 1, "pending", None, "old")],
        [("a", 3, "failed", "disk full", None), ("a", 2, "pending", None, "p2")],
        [("b", 2, "calibrated", None, "new"), ("a", 4, "calibrated", None, None), ("c", 9, "pending", None, None), ("a", 0, "queued", "late", "p0")],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(landed)
        jobs.job_state_stream(spark.readStream.schema(schema).json(landed), out, marks).awaitTermination()
        seen = [r for b in batches[: n + 1] for r in b]
        found, whole = (sorted(map(tuple, df.collect())) for df in (jobs.current_jobs(spark, out), jobs.job_states(spark.createDataFrame(seen, schema))))
        assert found == whole
    assert found == [("a", "calibrated", 5, None, "p2"), ("b", "calibrated", 2, None, "new"), ("c", "pending", 1, None, None)]


def test_rim_of_a_square_lake_on_a_slope(spark):
    n, lake = 15, {(r, c) for r in (7, 8) for c in (7, 8)}
    rows = [(k, r, c, 30.0 * c * (k + 1), (r, c) in lake and k == 0, r == 0) for k in (0, 1) for r in range(n) for c in range(n)]
    df = spark.createDataFrame(rows, "k int, r int, c int, z double, lake boolean, ice boolean")
    found = {x.k: x for x in lakes.rim_features(df, ["k"], F.col("lake"), F.col("ice"), 30.0).collect()}
    assert abs(found[0].rim_slope_mean - 45) < 1e-9 and abs(found[0].rim_slope_p90 - 45) < 1e-9 and found[0].relief == 30.0 * 14
    assert found[1].rim_slope_mean is None and found[1].rim_slope_p90 is None and abs(found[1].glacier_share - 1 / n) < 1e-12


def test_ridge_of_all_other_groups_against_numpy(spark):
    r = random.Random(5)
    rows = [(i, f"g{i % 11}", r.choice("abc"), r.choice("xyz"), r.uniform(-2, 2), r.uniform(1, 9), r.uniform(1, 9)) for i in range(60)]
    rows += [(60, "g12", "d", "x", 0.5, 2.0, 3.0), (61, "g1", "a", "w", 0.1, 2.0, 4.0)]  # a type of one group only, a rare region
    df = spark.createDataFrame(rows, "id int, g string, t string, region string, size double, law double, truth double")
    ready, names = learning.sparse_features(df, ["size"], {"t": 1, "region": 2})
    assert names == ["size", "t_a", "t_b", "t_c", "t_d", "region_x", "region_y", "region_z"]
    found = {x.id: x.estimate for x in learning.ridge_leave_groups_out(ready, "g", len(names), "law", "truth").collect()}
    x = np.array([[size, *(float(t == k) for k in "abcd"), *(float(region == k) for k in "xyz")] for _, _, t, region, size, _, _ in rows])
    y, groups = np.log([row[6] / row[5] for row in rows]), np.array([row[1] for row in rows])
    assert len(found) == len(rows)
    for i, row in enumerate(rows):
        train = groups != row[1]
        mean, sd = x[train].mean(0), x[train].std(0)
        sd[sd == 0] = 1
        z = (x[train] - mean) / sd
        w = np.linalg.solve(z.T @ z + np.eye(len(names)), z.T @ (y[train] - y[train].mean()))
        assert abs(found[row[0]] - row[5] * np.exp(y[train].mean() + (x[i] - mean) / sd @ w)) < 1e-8


def test_leakage_free_dataset(spark):
    """Events at the ends of a line of lakes; lakes beside an event are no stable ones, and give their area to it."""
    place = lambda i, km: (i, 28.0, 84.0 + km / 98.0, km * 1000.0, 0.0)
    schema = "id int, lat double, lon double, x double, y double, area_km2 double, elev_m double"
    events = spark.createDataFrame([(*place(1, 0), 9.0, 5000.0), (*place(2, 1.9), 9.0, None), (*place(3, 100), None, 4000.0), (*place(4, 102), 2.0, 4000.0), (*place(5, 104), 3.0, None)], schema)
    lakes = spark.createDataFrame([(*place(11, 0.2), 1.5, 4900.0), *[(*place(20 + i, 10.0 + i), 0.5, 4000.0) for i in range(4)], *[(*place(40 + i, 90.0 - i), 0.5, 4000.0) for i in range(9)], (*place(60, 95), None, 4000.0)], schema)
    ice = spark.createDataFrame([(1, 0.0, 2000.0, 1000.0, 2000.0), (1, 1000.0, 2000.0, 1000.0, 3000.0), (1, 1000.0, 3000.0, 0.0, 3000.0), (1, 0.0, 3000.0, 0.0, 2000.0)], "poly int, x1 double, y1 double, x2 double, y2 double")
    rows = learning.leakage_free_dataset(events, lakes, ice, negatives=6, k=2).collect()
    breached = {r.source_id: r for r in rows if r.breached}
    assert set(breached) == {1, 4}  # 2 and 5 have no elevation, 3 no area
    assert abs(breached[1].log_area - np.log1p(1.5)) < 1e-12 and breached[1].elev_m == 4900
    assert abs(breached[1].log_distance - np.log1p(2000)) < 1e-9 and abs(breached[1].log_ice - np.log1p(1.0)) < 1e-9 and breached[4].log_ice == 0
    stable = [r.source_id for r in rows if not r.breached]
    assert len(stable) == len(set(stable)) == 6 and not {11, 60} & set(stable)
    assert len({r.block for r in rows if not r.breached and r.source_id < 40}) == 1 and breached[1].block != breached[4].block
    assert sum(s < 40 for s in stable) == 3 and sum(s >= 40 for s in stable) == 3


def test_calibration_across_blocks(spark):
    r = random.Random(3)
    rows = [(i, i % 3, int(r.random() < 0.2 + 0.6 * (i % 10) / 9), (i % 10) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, block int, label int, score double")
    for method in ("platt", "isotonic"):
        got = learning.cross_calibrated(df, method=method).collect()
        assert len(got) == 300 and all(0 <= x.calibrated <= 1 for x in got)
        for b in range(3):
            curve = sorted({(x.score, x.calibrated) for x in got if x.block == b})
            assert len(curve) == 10 and all(p[1] <= q[1] + 1e-12 for p, q in zip(curve, curve[1:]))
    one = learning.cross_calibrated(df.where("block = 0 OR label = 1"))  # the other blocks of 0 have one class
    assert all(x.calibrated == x.score for x in one.where("block = 0").collect())


def test_prior_helps_where_static_features_decide(spark):
    rows = [(i, i % 3, int(i % 4 == 0), float(i % 4), float(i * 7 % 5), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, block int, label int, fixed double, noise double, late int")
    got = learning.stacked_prior(df, ["fixed"], ["noise"], test="late = 0", trees=1, depth=2).collect()
    assert sorted(x.id for x in got) == [i for i in range(120) if i % 2 == 0]
    auc = lambda f: np.mean([(f(p) > f(q)) + 0.5 * (f(p) == f(q)) for p in got if p.label == 1 for q in got if q.label == 0])
    assert auc(lambda x: x.stacked) > 0.99 and auc(lambda x: x.plain) < 0.8


def test_trends_of_basins_without_water_or_with_one_date(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 0.0, 2), (2, 1, 5.0, 3), (3, 1, 10.0, 4), (3, 2, 11.0, 5), (4, 1, 10.0, 6), (4, 2, 13.0, 7), (5, 1, 10.0, 8), (5, 2, 9.0, 9)], "basin_id int, acquired_at int, area double, observation_id int")
    assert values(weather.trend_class(a), "basin_id", "trend", "confidence") == [(1, "stable", 0.9), (2, "uncertain", 0.3), (3, "slowly", 0.5), (4, "rapidly", 0.8), (5, "uncertain", 0.3)]


def test_shadow_summary_without_gated_values_does_not_pass(spark):
    rows = spark.createDataFrame([(None, 0.4, None, None, True, None)], "brier double, p double, width double, iou double, triggered boolean, evidence boolean")
    got = {r.metric: r for r in evaluation.shadow_summary(rows).collect()}
    assert got["overall"].passed is False and got["brier"].passed is None and got["triggered"].value == 1 and got["evidence"].value == 0
    both = {r.metric: r.passed for r in evaluation.shadow_summary(rows.withColumns({"brier": F.lit(0.1), "iou": F.lit(0.65)})).collect()}
    assert both["overall"] is True and both["iou"] is True


def test_scene_verdict_needs_two_pairs_in_scope(spark):
    gates = spark.createDataFrame([("a", 0.3, True), ("b", 0.3, True), ("c", 0.3, False), ("b", 0.5, False)], "pair string, tau double, passed boolean")
    pairs = spark.createDataFrame([("a", True), ("b", True), ("c", True)], "pair string, in_scope boolean")
    assert values(evaluation.scene_verdict(pairs, gates, 0.3), "pairs", "in_scope", "passed", "eligible") == [(3, 3, 2, True)]
    assert not evaluation.scene_verdict(pairs.where("pair <> 'a'"), gates, 0.3).first().eligible
