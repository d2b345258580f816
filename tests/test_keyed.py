"""Rules over tables, and the map projection beside an independent integration."""

import cmath
import math

from pyspark.sql import functions as F
from tarnwatch.functions import projection
from tarnwatch.sources import keyed, tables


def integrated(lat, lon, zone):
    """Meridian arc continued to complex isometric latitude, by Runge-Kutta steps."""
    f = 1 / 298.257223563
    a, e2 = 6378137.0, f * (2 - f)
    k0, away, steps = 0.9996, math.radians(lon - (zone * 6 - 183)), 400

    def rates(p):
        w = 1 - e2 * cmath.sin(p) ** 2
        return w * cmath.cos(p) / (1 - e2), a * cmath.cos(p) / cmath.sqrt(w)

    h, p, n = math.radians(lat) / 4000, 0.0, 0.0
    for k in range(4000):  # Simpson along the meridian
        m = lambda x: a * (1 - e2) / (1 - e2 * math.sin(x) ** 2) ** 1.5
        n += h / 6 * (m(k * h) + 4 * m((k + 0.5) * h) + m((k + 1) * h))
    p, z, h = complex(math.radians(lat)), complex(n), 1j * away / steps
    for _ in range(steps):
        k1 = rates(p)
        k2 = rates(p + h / 2 * k1[0])
        k3 = rates(p + h / 2 * k2[0])
        k4 = rates(p + h * k3[0])
        p += h / 6 * (k1[0] + 2 * k2[0] + 2 * k3[0] + k4[0])
        z += h / 6 * (k1[1] + 2 * k2[1] + 2 * k3[1] + k4[1])
    return 500000 + k0 * z.imag, k0 * z.real + (1e7 if lat < 0 else 0)


def test_projection_within_a_millimetre(spark):
    places = [(lat, lon) for lat in (-30.0, 0.0, 5.0, 27.898, 45.5, 60.0) for lon in (83.0, 84.0, 86.925, 87.0, 88.7, 90.0)]
    df = spark.createDataFrame(places, "lat double, lon double")
    east, north = projection.utm_from_degrees(F.col("lat"), F.col("lon"), 45)
    for r in df.select("lat", "lon", east.alias("e"), north.alias("n")).collect():
        e, n = integrated(r.lat, r.lon, 45)
        assert abs(r.e - e) < 1e-3 and abs(r.n - n) < 1e-3
    back = projection.degrees_from_utm(F.col("e"), F.col("n"), 45)
    for r in df.where("lat >= 0").select("lat", "lon", east.alias("e"), north.alias("n")).select("lat", "lon", back[0].alias("la"), back[1].alias("lo")).collect():
        assert abs(r.la - r.lat) < 1e-8 and abs(r.lo - r.lon) < 1e-8


def test_survey_points_take_metres(spark):
    e, n = integrated(27.898, 86.925, 45)
    rows = [("a", "2002", "12.5", None, None, e, n), ("a", "2002", "3", 27.9, 86.9, None, None), ("a", "2002", "x", 27.9, 86.9, None, None), ("a", "2002", "4", None, None, None, n), ("a", "2002", "-1", 27.9, 86.9, None, None)]
    found = tables.projected_survey_points(spark.createDataFrame(rows, "lake string, surveyed string, depth string, lat double, lon double, east double, north double")).orderBy("depth").collect()
    assert [r.depth for r in found] == [3.0, 12.5] and abs(found[1].lat - 27.898) < 1e-8 and abs(found[1].lon - 86.925) < 1e-8


def test_rules_over_tables(spark):
    make = lambda table, *rows: keyed.typed_rows(spark.createDataFrame([(r,) for r in rows], "json string"), table)
    given = {
        "basins": make("basins", '{"basin_id": "b", "name": "n", "boundary_geojson": "{}"}', '{"basin_id": "b", "name": "n", "boundary_geojson": "{}"}'),
        "assets": make("assets", '{"asset_id": "a", "basin_id": "b", "asset_type": "well", "geometry_geojson": "{}"}', '{"asset_id": "z", "basin_id": "q", "geometry_geojson": "{}"}'),
        "scores": make("scores", '{"score_id": "s", "run_id": "r", "hazard_score": 1, "exposure_priority": 1, "confidence": 1, "severity": "critical", "reasons_json": "[1, 2]"}'),
        "acquisition_jobs": make("acquisition_jobs", '{"job_id": "1", "source": "x", "provider_product_id": "p"}', '{"job_id": "2", "source": "x", "provider_product_id": "p"}', '{"source": "y", "provider_product_id": "p"}'),
    }
    found = {tuple(r) for r in keyed.broken_rules(given).collect()}
    assert found == {
        ("basins", "b", "basin_id is repeated"),
        ("assets", "z", "asset_type is missing"),
        ("assets", "z", "basin_id is not in basins"),
        ("scores", "s", "severity NOT IN ('elevated', 'critical') OR json_array_length(reasons_json) >= 3"),
        ("acquisition_jobs", "2", "(source, provider_product_id) is not unique"),
        ("acquisition_jobs", None, "job_id is missing"),
    }
    assert given["assets"].head().weight == 1.0 and given["acquisition_jobs"].head().status == "pending"


def test_audit_rows_never_change(spark):
    log = lambda rows: spark.createDataFrame([(i, None, "x", a, "{}", None, "p", "h") for i, a in rows], keyed.TABLES["audit_log"].columns)
    found = keyed.forbidden_changes(log([(1, "run"), (2, "score"), (3, "review")]), log([(1, "run"), (3, "reject"), (4, "new")]), "audit_log")
    assert {tuple(r) for r in found.collect()} == {("2", "deleted"), ("3", "updated")}
