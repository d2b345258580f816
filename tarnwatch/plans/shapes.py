"""Registered queries of outlines, filled terrain, samples and areas, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.operators import evaluation as E
from tarnwatch.operators import grid as G
from tarnwatch.operators import lakes as L
from tarnwatch.operators import outlines as O
from tarnwatch.operators import spatial as P
from tarnwatch.operators import terrain as H
from tarnwatch.plans import standins as T
from tarnwatch.plans.evaluations import rounded
from tarnwatch.plans.grids import WIDTH

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Sides of true cells that face none, each with the side that follows it, and the walk along a ring from its smallest side.
_WALK = T.with_("cells").replace("WITH", "WITH RECURSIVE", 1) + f""",
mask AS (SELECT r::BIGINT AS r, c::BIGINT AS c FROM cells WHERE a > 70),
k AS (SELECT * FROM (VALUES (0, -1, 0, 0, 1, -1, 1, 0, 0), (1, 0, 1, 1, 0, 1, 1, 1, 0), (2, 1, 0, 0, -1, 1, -1, 1, 1), (3, 0, -1, -1, 0, -1, -1, 0, 1)) t(k, br, bc, ar, ac, dr, dc, bx, "by")),
sides AS (
  SELECT (m.r * {WIDTH} + m.c) * 4 + k AS side, m.c + bx AS x, m.r + "by" AS y,
    CASE WHEN a.r IS NULL THEN (m.r * {WIDTH} + m.c) * 4 + (k + 1) % 4
      WHEN d.r IS NULL THEN ((m.r + ar) * {WIDTH} + m.c + ac) * 4 + k
      ELSE ((m.r + dr) * {WIDTH} + m.c + dc) * 4 + (k + 3) % 4 END AS next
  FROM mask m CROSS JOIN k LEFT JOIN mask b ON b.r = m.r + br AND b.c = m.c + bc
  LEFT JOIN mask a ON a.r = m.r + ar AND a.c = m.c + ac LEFT JOIN mask d ON d.r = m.r + dr AND d.c = m.c + dc WHERE b.r IS NULL
), e AS (
  SELECT s.side, s.next, s.x, s.y, n.x AS nx, n.y AS ny, p.side % 4 <> s.side % 4 AS corner FROM sides s JOIN sides n ON n.side = s.next JOIN sides p ON p.next = s.side
), walk AS (
  SELECT side AS head, e.*, 0 AS step FROM e
  UNION ALL
  SELECT w.head, e.*, w.step + 1 FROM walk w JOIN e ON e.side = w.next WHERE w.next > w.head
), heads AS (SELECT head FROM walk WHERE next = head),
on_ring AS (SELECT walk.* FROM walk JOIN heads USING (head))
"""


@query("ring_outlines", _WALK + """
SELECT min(side) FILTER (corner) AS ring, count(*) FILTER (corner) AS corners, sum(x * ny - nx * y)::DOUBLE / 2 AS area, count(*) AS length FROM on_ring GROUP BY head""")
def _(spark, d):
    mask = T.cells(spark, d).where("a > 70")
    return O.ring_measures(O.ring_corners(mask, WIDTH))


@query("change_polygon", _WALK + f""",
reach AS (SELECT r * {WIDTH} + c AS id, r * {WIDTH} + c AS root, r, c FROM mask
  UNION SELECT m.r * {WIDTH} + m.c, x.root, m.r, m.c FROM reach x JOIN mask m ON abs(m.r - x.r) + abs(m.c - x.c) = 1),
labels AS (SELECT id, min(root) AS label FROM reach GROUP BY id),
largest AS (SELECT label FROM labels GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT row_number() OVER (ORDER BY step) - 1 AS seq, (86.65 + x * 0.0035)::DOUBLE AS x, (27.98 - y * 0.0035)::DOUBLE AS y
FROM on_ring JOIN largest ON head = label * 4 WHERE corner""")
def _(spark, d):
    mask = T.cells(spark, d).where("a > 70")
    return O.change_polygon(mask, WIDTH, x0=86.65, y0=27.98, step=0.0035)


@query("spill_levels")
def _(spark, d):
    return H.fill_depressions(T.cells(spark, d).select("r", "c", F.col("a").alias("z")), gradient=0, tile=64)


@query("clipped_sample", T.with_("cells") + f"""
, p AS (SELECT c_custkey AS id, (c_custkey * 7 % 1300) / 10.0::DOUBLE - 9 AS x, (c_custkey * 11 % 1300) / 10.0::DOUBLE AS y FROM customer), m AS (SELECT max(r) AS h FROM cells),
q AS (SELECT id, least(greatest(trunc(x)::BIGINT, 0), {WIDTH} - 1) AS c, least(greatest(trunc(120 - y)::BIGINT, 0), h) AS r FROM p, m) SELECT id, a FROM q LEFT JOIN cells USING (r, c)""")
def _(spark, d):
    k = F.col("c_custkey")
    p = T.table(spark, d, "customer").select(k.alias("id"), ((k * 7 % 1300) / 10.0 - 9).alias("x"), ((k * 11 % 1300) / 10.0).alias("y"))
    return G.clipped_sample(p, T.cells(spark, d), "a", x0=0.0, y0=120.0, step=1.0, shape=T.shape(spark, d)).select("id", "a")


@query("degree_change_stats", T.with_("cells") + """
SELECT r // 10 AS scene, count(*) FILTER (WHERE a > 60) AS cells, round(count(*) FILTER (WHERE a > 60) * (0.001 * 111320 * cos(radians(27.9)) * 0.001 * 110540 / 1000000), 9) AS km2 FROM cells GROUP BY 1""")
def _(spark, d):
    scenes = T.cells(spark, d).withColumn("scene", F.floor(F.col("r") / 10))
    return rounded(G.change_stats(scenes, ["scene"], F.col("a") > 60, G.cell_area_km2(0.001, 0.001, 27.8, 28.0)), "km2")


@query("best_by_iou", T.with_("scores") + """
, c AS (SELECT tau, count(*) FILTER (WHERE label = 1 AND score >= tau) AS tp, count(*) FILTER (WHERE label <> 1 AND score >= tau) AS fp, count(*) FILTER (WHERE label = 1 AND score < tau) AS fn FROM scores, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS tau) GROUP BY tau)
SELECT tau, round(tp / (tp + fp + fn), 9) AS iou FROM c ORDER BY tp / (tp + fp + fn) DESC, tau LIMIT 1""")
def _(spark, d):
    return rounded(E.best_by_iou(E.threshold_sweep(T.scores(spark, d), [0.1, 0.3, 0.5, 0.7, 0.9], "block")), "iou").select("tau", "iou")


_STATUS = """
, w AS (SELECT event_id, event_date + (event_id % 3 * 1200)::INT AS day FROM catalogue),
f AS (SELECT event_id AS want_id, observation_id AS scene_id, cloud_fraction * 100 AS cloud, abs(acquired_at - day)::INT AS off FROM w JOIN observations ON acquired_at BETWEEN day - 7 AND day + 7),
k AS (SELECT *, row_number() OVER (PARTITION BY want_id ORDER BY cloud, off, scene_id) AS rank FROM f QUALIFY rank <= 6)
SELECT event_id AS want_id, CASE WHEN min(scene_id) IS NULL THEN 'no_scenes' ELSE 'found' END AS status, min(scene_id) FILTER (rank = 1) AS scene_id, min(cloud) FILTER (rank = 1) AS cloud, min(off) FILTER (rank = 1) AS off,
  min(cloud) FILTER (rank = 1) <= 30 AS clear, greatest(count(scene_id) - 1, 0) AS fallbacks FROM w LEFT JOIN k ON want_id = event_id GROUP BY event_id"""


@query("scene_date_status", T.with_("catalogue", "observations") + _STATUS)
def _(spark, d):
    """Some dates lie after the last scene."""
    w = T.catalogue(spark, d).selectExpr("event_id AS want_id", "date_add(event_date, int(event_id % 3 * 1200)) AS day")
    s = T.observations(spark, d).selectExpr("observation_id AS scene_id", "cloud_fraction * 100 AS cloud", "acquired_at AS taken")
    return P.scene_date_status(w, P.scene_date_candidates(w, s))


@query("region_and_edits", T.with_("cells") + """
, l AS (SELECT r, c, CASE WHEN (b % 7)::INT NOT IN (0, 1, 2, 3) THEN 255 WHEN a > 60 AND b < 80 THEN 1 ELSE 0 END AS label, c::DOUBLE AS x, r::DOUBLE AS y FROM cells),
g AS (SELECT *, sqrt(pow(greatest(10.3 - x, 0, x - 60.3), 2) + pow(greatest(20.3 - y, 0, y - 70.3), 2)) <= 5 AS near FROM l)
SELECT r, c, CASE WHEN x BETWEEN 30.4 AND 50.4 AND y BETWEEN 30.4 AND 80.4 THEN 0 WHEN x BETWEEN 5.4 AND 40.4 AND y BETWEEN 25.4 AND 40.4 THEN 1 WHEN near THEN label ELSE 255 END AS label FROM g""")
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    labels = T.cells(spark, d).select("r", "c", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), G.candidate_label((b % 7).cast("int"), a, 60, clear=(0, 1, 2, 3), snow=b, most_snow=80).alias("label"))
    box = lambda w, s, e, n: spark.createDataFrame([(1, w, s, e, s), (1, e, s, e, n), (1, e, n, w, n), (1, w, n, w, s)], "poly int, x1 double, y1 double, x2 double, y2 double")
    inside = L.region_label(labels, box(10.3, 20.3, 60.3, 70.3), 5.0, 4.0)
    return L.edited_label(inside, box(5.4, 25.4, 40.4, 40.4), box(30.4, 30.4, 50.4, 80.4), 4.0).select("r", "c", "label")
