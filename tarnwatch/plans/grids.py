"""Registered queries of the grid and terrain operators; the grid is the events table, 100 cells wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions import scalars as S
from tarnwatch.operators import grid as G
from tarnwatch.operators import terrain as H
from tarnwatch.plans import standins as T
from tarnwatch.plans.evaluations import rounded

QUERIES, ORACLE_SQL = {}, {}
WIDTH = 100


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


C = T.with_("cells")


@query("ndwi_mndwi", C + "SELECT r, c, round((a - b) / (a + b + 1e-10), 9) AS ndwi, CASE WHEN a + b = 0 THEN 0 ELSE round((a - b) / (a + b), 9) END AS safe, (a - b) / (a + b + 1e-10) > 0.2 AS water FROM cells")
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    return T.cells(spark, d).select("r", "c", F.round(G.ndwi(a, b), 9).alias("ndwi"), F.round(G.ndwi(a, b, True), 9).alias("safe"), (G.ndwi(a, b) > 0.2).alias("water"))


@query("bright_cloud_mask", C + "SELECT r // 10 AS scene, coalesce(count(*) FILTER (WHERE a <> 0 AND b <> 0 AND a > 50 AND b > 50) / nullif(count(*) FILTER (WHERE a <> 0 AND b <> 0), 0), 0)::DOUBLE AS cloud FROM cells GROUP BY 1")
def _(spark, d):
    return T.cells(spark, d).groupBy(F.floor(F.col("r") / 10).alias("scene")).agg(G.cloud_fraction([F.col("a"), F.col("b")], 50, 0).alias("cloud"))


@query("scl_mask_histogram", C + "SELECT r // 10 AS scene, (b % 12)::INT AS kind, count(*) AS cells, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY r // 10) AS share, (b % 12)::INT IN (3, 8, 9, 10) AS cloud FROM cells GROUP BY 1, 2")
def _(spark, d):
    k = T.cells(spark, d).select(F.floor(F.col("r") / 10).alias("scene"), (F.col("b") % 12).cast("int").alias("kind"))
    return G.class_histogram(k, ["scene"], "kind").withColumn("cloud", F.col("kind").isin(3, 8, 9, 10))


@query("multilook", C + """
, o AS (SELECT unnest(range(-2, 3)) AS o), m AS (SELECT max(r) AS mr, max(c) AS mc FROM cells),
x AS (SELECT cells.r, cells.c, CASE WHEN cells.r + i.o < 0 THEN -1 - (cells.r + i.o) WHEN cells.r + i.o > mr THEN 2 * mr + 1 - (cells.r + i.o) ELSE cells.r + i.o END AS sr, CASE WHEN cells.c + j.o < 0 THEN -1 - (cells.c + j.o) WHEN cells.c + j.o > mc THEN 2 * mc + 1 - (cells.c + j.o) ELSE cells.c + j.o END AS sc FROM cells, o i, o j, m)
SELECT x.r, x.c, round(sum(s.a::DECIMAL(18,2))::DOUBLE / 25, 6) AS a FROM x JOIN cells s ON s.r = sr AND s.c = sc GROUP BY 1, 2""")
def _(spark, d):
    return rounded(G.multilook(T.cells(spark, d), "a"), "a", digits=6)


@query("detect_expansion", C + """
, o AS (SELECT unnest(range(-2, 3)) AS o), m AS (SELECT max(r) AS mr, max(c) AS mc FROM cells),
x AS (SELECT cells.r, cells.c, CASE WHEN cells.r + i.o < 0 THEN -1 - (cells.r + i.o) WHEN cells.r + i.o > mr THEN 2 * mr + 1 - (cells.r + i.o) ELSE cells.r + i.o END AS sr, CASE WHEN cells.c + j.o < 0 THEN -1 - (cells.c + j.o) WHEN cells.c + j.o > mc THEN 2 * mc + 1 - (cells.c + j.o) ELSE cells.c + j.o END AS sc FROM cells, o i, o j, m),
l AS (SELECT x.r, x.c, sum(s.a) / 25 AS a, sum(s.b) / 25 AS b FROM x JOIN cells s ON s.r = sr AND s.c = sc GROUP BY 1, 2)
SELECT r, c, round(log10((b * b + 1e-6) / (a * a + 1e-6)), 6) AS ratio, log10((b * b + 1e-6) / (a * a + 1e-6)) < -0.3 AS expanded FROM l""")
def _(spark, d):
    return rounded(G.detect_expansion(T.cells(spark, d), "a", "b", -0.3), "ratio", digits=6)


@query("sigma0_db", C + "SELECT r, c, round(10 * log10(greatest(a * a / (CASE WHEN b > 0 THEN b ELSE 1 END * CASE WHEN b > 0 THEN b ELSE 1 END), 1e-10)), 6) AS db FROM cells")
def _(spark, d):
    return T.cells(spark, d).select("r", "c", F.round(G.sigma0_db(F.col("a"), F.col("b")), 6).alias("db"))


_N = """
, n AS (SELECT m.r, m.c, m.a AS z, w.a AS w, e.a AS e, u.a AS n, s.a AS s FROM cells m LEFT JOIN cells w ON w.r = m.r AND w.c = m.c - 1 LEFT JOIN cells e ON e.r = m.r AND e.c = m.c + 1
  LEFT JOIN cells u ON u.r = m.r - 1 AND u.c = m.c LEFT JOIN cells s ON s.r = m.r + 1 AND s.c = m.c),
g AS (SELECT r, c, z, CASE WHEN w IS NOT NULL AND e IS NOT NULL THEN (e - w) / 60 WHEN e IS NOT NULL THEN (e - z) / 30 WHEN w IS NOT NULL THEN (z - w) / 30 ELSE 0 END AS dx,
  CASE WHEN n IS NOT NULL AND s IS NOT NULL THEN (s - n) / 60 WHEN s IS NOT NULL THEN (s - z) / 30 WHEN n IS NOT NULL THEN (z - n) / 30 ELSE 0 END AS dy FROM n)"""


def _z(spark, d):
    return T.cells(spark, d).select("r", "c", F.col("a").alias("z"), "b")


@query("dem_slope", C + _N + "SELECT r, c, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round(1 / sqrt(dx * dx + dy * dy + 1), 6) AS nz FROM g")
def _(spark, d):
    return rounded(G.slope_degrees(_z(spark, d), 30.0).select("r", "c", "slope", "nz"), "slope", "nz", digits=6)


@query("gamma0_terrain_correct", C + _N + """
, k AS (SELECT r, c, (-dx / sqrt(dx*dx+dy*dy+1)) * sin(radians(35.0)) * sin(radians(100.0)) + (dy / sqrt(dx*dx+dy*dy+1)) * sin(radians(35.0)) * cos(radians(100.0)) + 1 / sqrt(dx*dx+dy*dy+1) * cos(radians(35.0)) AS k FROM g)
SELECT r, c, round(CASE WHEN k > 0 THEN -b / 5 - 10 * log10(greatest(k, 1e-3)) ELSE -b / 5 END, 6) + 0 AS gamma FROM k JOIN cells USING (r, c)""")
def _(spark, d):
    s = G.slope_degrees(_z(spark, d), 30.0).join(T.cells(spark, d).select("r", "c", "b"), ["r", "c"])
    k = G.local_incidence_cos(F.col("nx"), F.col("ny"), F.col("nz"), 35.0, 100.0)
    return s.select("r", "c", F.round(G.gamma0(-F.col("b") / 5, k), 6).alias("gamma"))


@query("sobel_slope", C + """
, n AS (SELECT m.r, m.c, m.a AS z, max(x.a) FILTER (WHERE x.r = m.r AND x.c = m.c - 1) AS w, max(x.a) FILTER (WHERE x.r = m.r AND x.c = m.c + 1) AS e, max(x.a) FILTER (WHERE x.r = m.r - 1 AND x.c = m.c) AS n, max(x.a) FILTER (WHERE x.r = m.r + 1 AND x.c = m.c) AS s,
  max(x.a) FILTER (WHERE x.r = m.r - 1 AND x.c = m.c - 1) AS nw, max(x.a) FILTER (WHERE x.r = m.r - 1 AND x.c = m.c + 1) AS ne, max(x.a) FILTER (WHERE x.r = m.r + 1 AND x.c = m.c - 1) AS sw, max(x.a) FILTER (WHERE x.r = m.r + 1 AND x.c = m.c + 1) AS se
  FROM cells m JOIN (SELECT unnest(range(-1, 2)) AS i) ON true JOIN cells x ON x.r = m.r + i AND x.c BETWEEN m.c - 1 AND m.c + 1 GROUP BY 1, 2, 3),
f AS (SELECT r, c, coalesce(w, z) AS w, coalesce(e, z) AS e, coalesce(n, z) AS n, coalesce(s, z) AS s, coalesce(nw, w, n, z) AS nw, coalesce(ne, e, n, z) AS ne, coalesce(sw, w, s, z) AS sw, coalesce(se, e, s, z) AS se FROM n)
SELECT r, c, round(degrees(atan(sqrt(pow((ne + 2 * e + se - nw - 2 * w - sw) / 240, 2) + pow((sw + 2 * s + se - nw - 2 * n - ne) / 240, 2)))), 6) AS slope FROM f""")
def _(spark, d):
    return rounded(G.sobel_slope(_z(spark, d), 30.0), "slope", digits=6)


_GAPS = "cells0 AS (" + T.SQL["cells"] + "), cells AS (SELECT r, c, CASE WHEN (r * 7 + c) % 53 = 0 THEN NULL ELSE a END AS a FROM cells0), med AS (SELECT median(a) AS m FROM cells)"


def _gaps(spark, d):
    return T.cells(spark, d).select("r", "c", F.when((F.col("r") * 7 + F.col("c")) % 53 != 0, F.col("a")).alias("z"))


@query("sobel_slope_filled", "WITH " + _GAPS + ", z AS (SELECT r, c, coalesce(a, m) AS a FROM cells, med), s AS (" + ORACLE_SQL["sobel_slope"].replace(C, "WITH q AS (SELECT 1)").replace("cells", "z") + ") SELECT r, c, CASE WHEN cells.a IS NOT NULL THEN slope END AS slope FROM s JOIN cells USING (r, c)")
def _(spark, d):
    return rounded(G.sobel_slope(_gaps(spark, d), 30.0), "slope", digits=6)


@query("geographic_slope", "WITH " + _GAPS + """
, n AS (SELECT m.r, m.c, coalesce(m.a, 'nan'::DOUBLE) AS z, CASE WHEN w.r IS NOT NULL THEN coalesce(w.a, 'nan'::DOUBLE) END AS w, CASE WHEN e.r IS NOT NULL THEN coalesce(e.a, 'nan'::DOUBLE) END AS e, CASE WHEN u.r IS NOT NULL THEN coalesce(u.a, 'nan'::DOUBLE) END AS n, CASE WHEN s.r IS NOT NULL THEN coalesce(s.a, 'nan'::DOUBLE) END AS s,
  111320.0::DOUBLE * cos(radians(28.0::DOUBLE - (m.r + 0.5::DOUBLE) * 0.001::DOUBLE)) * 0.001::DOUBLE AS kx, 110540.0::DOUBLE * 0.001::DOUBLE AS ky
  FROM cells m LEFT JOIN cells w ON w.r = m.r AND w.c = m.c - 1 LEFT JOIN cells e ON e.r = m.r AND e.c = m.c + 1 LEFT JOIN cells u ON u.r = m.r - 1 AND u.c = m.c LEFT JOIN cells s ON s.r = m.r + 1 AND s.c = m.c),
g AS (SELECT r, c, CASE WHEN w IS NOT NULL AND e IS NOT NULL THEN (e - w) / (2 * kx) WHEN e IS NOT NULL THEN (e - z) / kx WHEN w IS NOT NULL THEN (z - w) / kx ELSE 0 END AS dx, CASE WHEN n IS NOT NULL AND s IS NOT NULL THEN (s - n) / (2 * ky) WHEN s IS NOT NULL THEN (s - z) / ky WHEN n IS NOT NULL THEN (z - n) / ky ELSE 0 END AS dy FROM n)
SELECT r, c, CASE WHEN NOT isnan(dx + dy) THEN round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) END AS slope FROM g""")
def _(spark, d):
    return rounded(G.geographic_slope(_gaps(spark, d), top=28.0, step=0.001).select("r", "c", "slope"), "slope", digits=6)


@query("nearest_sample", C + """
, p AS (SELECT c_custkey AS id, (c_custkey * 7 % 1300) / 10.0::DOUBLE AS x, (c_custkey * 11 % 1300) / 10.0::DOUBLE AS y FROM customer),
q AS (SELECT id, round_even(x, 0)::BIGINT AS c, round_even(130 - y, 0)::BIGINT AS r FROM p) SELECT id, coalesce(a, -1) AS a FROM q LEFT JOIN cells USING (r, c)""")
def _(spark, d):
    k = F.col("c_custkey")
    p = T.table(spark, d, "customer").select(k.alias("id"), ((k * 7 % 1300) / 10.0).alias("x"), ((k * 11 % 1300) / 10.0).alias("y"))
    return G.nearest_sample(p, T.cells(spark, d), "a", x0=0.0, y0=130.0, step=1.0, fill=-1.0).select("id", "a")


@query("resize_grid", C + ", s AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells), t AS (SELECT h, w, unnest(range(h * 2 // 3)) AS i FROM s) SELECT i AS r, j AS c, a FROM t, (SELECT unnest(range(53)) AS j), cells WHERE r = i * h // (h * 2 // 3) AND c = j * w // 53")
def _(spark, d):
    """The whole grid, onto two thirds of its rows and 53 columns."""
    h, w = T.shape(spark, d)
    return G.resize_nearest(T.cells(spark, d), "a", (h, w), (h * 2 // 3, 53))


@query("nan_median_fill_scale", C + """
, v AS (SELECT r, c, r // 10 AS scene, CASE WHEN b > 90 THEN NULL ELSE -b / 3 END AS v FROM cells), m AS (SELECT scene, coalesce(median(v), -30) AS m FROM v GROUP BY scene)
SELECT r, c, round(greatest(0, least(1, (coalesce(v, m) + 30) / 30)), 9) AS v FROM v JOIN m USING (scene)""")
def _(spark, d):
    v = T.cells(spark, d).select("r", "c", F.floor(F.col("r") / 10).alias("scene"), F.when(F.col("b") <= 90, -F.col("b") / 3).alias("v"))
    return rounded(G.median_fill_scale(v, "v", ["scene"]).select("r", "c", "v"), "v")


@query("dilate", C + "SELECT DISTINCT r + i AS r, c + j AS c FROM cells, (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j) WHERE a > 150 AND abs(i) + abs(j) <= 1")
def _(spark, d):
    return G.dilate(T.cells(spark, d).where("a > 150"))


@query("erode", C + ", m AS (SELECT r, c FROM cells WHERE a < 150) SELECT r, c FROM (SELECT r + i AS r, c + j AS c FROM m, (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j) WHERE abs(i) + abs(j) <= 1) GROUP BY 1, 2 HAVING count(*) = 5")
def _(spark, d):
    return G.erode(T.cells(spark, d).where("a < 150"))


_MASK = C + ", mask AS (SELECT r, c, r * 100 + c AS id FROM cells WHERE a > 70)"


@query("connected_components", _MASK.replace("WITH", "WITH RECURSIVE", 1) + """
, reach AS (SELECT id, id AS root, r, c FROM mask UNION SELECT x.id, m.id AS root, m.r, m.c FROM reach x JOIN mask m ON abs(m.r - x.r) + abs(m.c - x.c) = 1)
SELECT r, c, min(reach.root) AS label FROM mask JOIN reach ON reach.id = mask.id GROUP BY ALL""".replace("SELECT r, c, min(reach.root)", "SELECT mask.r, mask.c, min(reach.root)"))
def _(spark, d):
    return G.label_components(T.cells(spark, d).where("a > 70"), WIDTH)


@query("local_std", C + """
SELECT m.r, m.c, round(stddev_pop(x.a), 5) AS std FROM cells m JOIN (SELECT unnest(range(-1, 2)) AS i) ON true JOIN cells x ON x.r = m.r + i AND x.c BETWEEN m.c - 1 AND m.c + 1 GROUP BY 1, 2""")
def _(spark, d):
    return rounded(G.local_std(T.cells(spark, d), "a"), "std", digits=5)


@query("windowed_fraction", C + """
SELECT m.r, m.c, coalesce(count(*) FILTER (WHERE x.a > 60 AND x.b > 20) / nullif(count(*) FILTER (WHERE x.b > 20), 0), 0)::DOUBLE AS water, count(*) FILTER (WHERE x.b > 20) / count(*) AS valid
FROM cells m JOIN (SELECT unnest(range(-2, 3)) AS i) ON true JOIN cells x ON x.r = m.r + i AND x.c BETWEEN m.c - 2 AND m.c + 2 GROUP BY 1, 2""")
def _(spark, d):
    return G.windowed_fraction(T.cells(spark, d), F.col("a") > 60, F.col("b") > 20, 2)


@query("change_stats", C + "SELECT r // 10 AS scene, count(*) FILTER (WHERE a > 60) AS cells, round(count(*) FILTER (WHERE a > 60) * 0.0001, 9) AS km2 FROM cells GROUP BY 1")
def _(spark, d):
    return rounded(G.change_stats(T.cells(spark, d).withColumn("scene", F.floor(F.col("r") / 10)), ["scene"], F.col("a") > 60, 1e-4), "km2")


_P = C + ", p AS (SELECT r, c, least(1.0::DOUBLE, a / 200) AS p0, b / 100 AS p1 FROM cells)"


def _p(spark, d):
    return T.cells(spark, d).select("r", "c", F.least(F.lit(1.0), F.col("a") / 200).alias("p0"), (F.col("b") / 100).alias("p1"))


@query("state_and_change", _P + "SELECT r, c, p0 >= 0.5 AS water_0, p1 >= 0.5 AS water_1, p1 >= 0.5 AND p0 < 0.5 AS expansion, p1 >= 0.5 AND p1 - p0 >= 0.2 AS delta_expansion, p0 >= 0.5 AND p1 < 0.5 AS drainage, round(greatest(0, least(1, p1 - p0)), 9) AS change FROM p")
def _(spark, d):
    return rounded(_p(spark, d).select("r", "c", *[v.alias(k) for k, v in G.state_and_change(F.col("p0"), F.col("p1")).items()]), "change")


@query("terrain_gate", C + """
SELECT r // 10 AS scene, count(*) FILTER (WHERE a > 40) AS raw, count(*) FILTER (WHERE a > 40 AND c < 10) AS outside, count(*) FILTER (WHERE a > 40 AND c >= 10 AND b > 50) AS steep, count(*) FILTER (WHERE a > 40 AND c >= 10 AND b <= 50 AND r % 3 = 0 AND c % 2 <> 0) AS glacier,
  count(*) FILTER (WHERE a > 40 AND c >= 10 AND b <= 50 AND NOT (r % 3 = 0 AND c % 2 <> 0)) AS gated, count(*) FILTER (WHERE a > 40 AND c >= 10 AND b <= 50 AND c % 2 = 0) AS near_lake FROM cells GROUP BY 1""")
def _(spark, d):
    r, c = F.col("r"), F.col("c")
    return T.cells(spark, d).groupBy(F.floor(r / 10).alias("scene")).agg(*G.terrain_gate(F.col("a") > 40, c >= 10, F.col("b"), r % 3 == 0, c % 2 == 0, 50.0))


@query("consensus_mask", C + "SELECT r, c, b > 60 OR (a > 50 AND c <= 35) AS consensus, CASE WHEN b > 60 AND a > 50 AND c <= 35 THEN 0.95 WHEN a > 50 AND c <= 35 THEN 0.6 WHEN b > 60 THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM cells")
def _(spark, d):
    k = G.consensus(F.col("a") > 50, F.col("b") > 60, F.col("c"))
    return T.cells(spark, d).select("r", "c", *[v.alias(n) for n, v in k.items()])


@query("mask_union_counts", C + "SELECT count(*) FILTER (WHERE a > 60 OR b > 60) AS both_or_either, count(*) FILTER (WHERE a > 60 AND b <= 60) AS only_first, count(*) FILTER (WHERE b > 60 AND a <= 60) AS only_second FROM cells")
def _(spark, d):
    return T.cells(spark, d).agg(*G.union_counts(F.col("a") > 60, F.col("b") > 60))


@query("interval_change_cells", _P + """
SELECT count(*) FILTER (WHERE p1 - s >= 0.5 AND p0 + s < 0.5) AS conservative, count(*) FILTER (WHERE p1 >= 0.5 AND p0 < 0.5) AS expected, count(*) FILTER (WHERE p1 + s >= 0.5 AND p0 - s < 0.5) AS generous FROM (SELECT *, CASE WHEN c % 2 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS s FROM p)""")
def _(spark, d):
    return _p(spark, d).agg(*G.interval_counts(F.col("p0"), F.col("p1"), 0.1, F.col("c") % 2 == 0))


@query("mc_sample_summary", C + "SELECT r, round(avg(a), 6) AS mean, round(var_samp(a), 5) AS variance, round(quantile_cont(a, 0.05), 6) AS low, round(quantile_cont(a, 0.95), 6) AS high FROM cells GROUP BY r")
def _(spark, d):
    out = G.sample_summary(T.cells(spark, d), ["r"], "a")
    return rounded(rounded(out, "mean", "low", "high", digits=6), "variance", digits=5)


@query("tta_average", C + """
, s AS (SELECT max(r) AS h, max(c) AS w FROM cells)
SELECT r, c, avg(p) AS p FROM (SELECT r, c, b AS p FROM cells UNION ALL SELECT h - r, c, b FROM cells, s UNION ALL SELECT r, w - c, b FROM cells, s UNION ALL SELECT r, w - c, b FROM cells, s UNION ALL SELECT h - r, c, b FROM cells, s) GROUP BY 1, 2""")
def _(spark, d):
    """Layers of the same numbers, as if each had been made under its flip or turn (turned ones on the transposed grid)."""
    p = T.cells(spark, d).select("r", "c", F.col("b").alias("p"))
    turned = p.select(F.col("c").alias("r"), F.col("r").alias("c"), "p")
    return G.tta_average({"id": p, "ud": p, "lr": p, "rot90": turned, "rot270": turned}, *T.shape(spark, d))


@query("label_merge_first_valid", C + ", k AS (SELECT r // 4 AS r, c, r % 4 AS priority, (b % 5)::INT AS kind FROM cells) SELECT r, c, coalesce(arg_min(kind, priority) FILTER (WHERE kind IN (0, 1)), 255)::INT AS label FROM k GROUP BY 1, 2")
def _(spark, d):
    k = T.cells(spark, d).select(F.floor(F.col("r") / 4).alias("r"), "c", (F.col("r") % 4).alias("priority"), (F.col("b") % 5).cast("int").alias("kind"))
    return G.first_valid_label(k)


@query("candidate_label", C + "SELECT r, c, CASE WHEN (b % 5)::INT NOT IN (0, 1) THEN 255 WHEN a > 60 THEN 1 ELSE 0 END AS label, CASE WHEN c < 5 THEN -1 WHEN b > 80 THEN 1 WHEN a > 60 THEN 1 ELSE 0 END AS weak FROM cells")
def _(spark, d):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return T.cells(spark, d).select("r", "c", G.candidate_label((b % 5).cast("int"), a, 60).alias("label"), G.weak_label([(a > 60, 1), (b > 80, 1), (c < 5, -1)]).alias("weak"))


@query("chips", C + "SELECT r // 10 AS chip_r, c // 10 AS chip_c, count(*) AS cells, count(*) FILTER (WHERE (b % 5)::INT IN (0, 1)) AS labelled, count(*) FILTER (WHERE (b % 5)::INT = 1) AS positive FROM cells GROUP BY 1, 2 HAVING count(*) FILTER (WHERE (b % 5)::INT IN (0, 1)) >= 40")
def _(spark, d):
    return G.chips(T.cells(spark, d), 10, (F.col("b") % 5).cast("int"), 0.4)


@query("background_chips", C + """
, s AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells), i AS (SELECT unnest(range(0, (SELECT h FROM s)::BIGINT - 8 + 1, 5)) AS row), j AS (SELECT unnest(range(0, (SELECT w FROM s)::BIGINT - 8 + 1, 5)) AS col)
SELECT row, col, count(*) AS cells FROM i, j JOIN cells ON r >= row AND r < row + 8 AND c >= col AND c < col + 8 GROUP BY row, col HAVING count(*) FILTER (WHERE a > 150) = 0 ORDER BY md5('3:' || row || ':' || col), row, col LIMIT 40""")
def _(spark, d):
    return G.background_chips(T.cells(spark, d), 8, 5, F.col("a") > 150, 40, 3)


_CHIPPED = C + ", x AS (SELECT r % 4 AS pair, (r // 16) * 100 + c // 8 AS chip, r, c, (b % 5 = 1)::INT AS label, (a > 40)::INT AS rule FROM cells)"


def _chipped(spark, d):
    cells = T.cells(spark, d).withColumn("pair", F.col("r") % 4)
    chip_cells = cells.select("pair", (F.floor(F.col("r") / 16) * 100 + F.floor(F.col("c") / 8)).alias("chip"), "r", "c", (F.col("b") % 5 == 1).cast("int").alias("label"))
    return G.rule_channel(chip_cells, cells.where("a > 40"))


@query("rule_channel_chips", _CHIPPED + "SELECT * FROM x")
def _(spark, d):
    return _chipped(spark, d)


@query("rule_report", _CHIPPED + "SELECT pair, count(DISTINCT (pair, chip)) AS chips, count(*) FILTER (WHERE rule = 1) AS rule_cells, count(*) FILTER (WHERE label = 1) AS label_cells, round(count(*) FILTER (WHERE rule = 1 AND label = 1) / nullif(count(*) FILTER (WHERE rule = 1 OR label = 1), 0), 9) AS iou FROM x GROUP BY ROLLUP (pair)")
def _(spark, d):
    return rounded(G.rule_report(_chipped(spark, d)), "iou")


@query("dem_difference", C + "SELECT round(sum(CASE WHEN b - a < -5 THEN (a - b) * 900 ELSE 0 END), 3) AS lost_m3, round(sum(CASE WHEN b - a > 5 THEN (b - a) * 900 ELSE 0 END), 3) AS gained_m3, count(*) FILTER (WHERE b - a < -5) AS lost_cells, count(*) FILTER (WHERE b - a > 5) AS gained_cells, count(b - a) AS valid FROM cells")
def _(spark, d):
    return rounded(G.dem_difference(T.cells(spark, d), "a", "b", 5, 5, 900), "lost_m3", "gained_m3", digits=3)


@query("lake_rim_level", C + """
, w AS (SELECT r, c, a AS z, a < 20 AS wet FROM cells), rim AS (SELECT min(d.z) AS level FROM w d WHERE NOT d.wet AND EXISTS (SELECT 1 FROM w x WHERE x.wet AND abs(x.r - d.r) + abs(x.c - d.c) = 1 AND x.r BETWEEN d.r - 1 AND d.r + 1))
SELECT level, round(sum(greatest(0, level - z)), 6) AS depth_sum, count(*) AS cells FROM w, rim WHERE wet GROUP BY level""")
def _(spark, d):
    return rounded(G.lake_rim_level(_z(spark, d), F.col("z") < 20), "depth_sum", digits=6)


@query("lake_visibility_audit", C + """
, a AS (SELECT (b % 40)::INT AS lake, count(*) AS cells, round(median(-a / 5), 6) AS median_vv, round(median(-a / 4), 6) AS median_vh, avg((-a / 5 < -15)::INT::DOUBLE) AS dark FROM cells GROUP BY 1 HAVING count(*) >= 3)
SELECT *, CASE WHEN dark > 0.5 THEN 'monitorable' WHEN dark < 0.2 AND median_vv > -12 THEN 'invisible' ELSE 'marginal' END AS class FROM a""")
def _(spark, d):
    v = T.cells(spark, d).select((F.col("b") % 40).cast("int").alias("lake"), (-F.col("a") / 5).alias("vv"), (-F.col("a") / 4).alias("vh"))
    return rounded(G.visibility_audit(v, "lake", "vv", "vh"), "median_vv", "median_vh", digits=6)


@query("swath_edge", T.with_("lakes") + "SELECT round(lat, 1) AS lat, max(lon) AS lon FROM lakes GROUP BY 1")
def _(spark, d):
    return G.swath_edge(T.lakes(spark, d))


_D8 = C + """
, o AS (SELECT unnest([{'k': 1, 'i': -1, 'j': 0}, {'k': 2, 'i': -1, 'j': 1}, {'k': 3, 'i': 0, 'j': 1}, {'k': 4, 'i': 1, 'j': 1}, {'k': 5, 'i': 1, 'j': 0}, {'k': 6, 'i': 1, 'j': -1}, {'k': 7, 'i': 0, 'j': -1}, {'k': 8, 'i': -1, 'j': -1}]) AS o),
s AS (SELECT m.r, m.c, o.k AS k, (m.a - x.a) / CASE WHEN o.i <> 0 AND o.j <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1 END AS drop, x.r AS xr, x.c AS xc FROM cells m, o JOIN cells x ON x.r = m.r + o.i AND x.c = m.c + o.j),
b AS (SELECT r, c, arg_max({'k': k, 'r': xr, 'c': xc}, (drop, -k)) FILTER (WHERE drop > 0) AS best FROM s GROUP BY 1, 2),
flow AS (SELECT r, c, coalesce(best.k, 0)::INT AS code, best.r AS to_r, best.c AS to_c FROM b)"""


@query("d8_direction", _D8 + "SELECT r, c, code, to_r, to_c FROM flow")
def _(spark, d):
    return H.d8_direction(_z(spark, d)).drop("z")


_ACC = _D8.replace("WITH", "WITH RECURSIVE", 1) + """
, p AS (SELECT r, c, to_r, to_c FROM flow), walk AS (SELECT r AS r0, c AS c0, r, c FROM p UNION ALL SELECT r0, c0, p.to_r, p.to_c FROM walk JOIN p USING (r, c) WHERE p.to_r IS NOT NULL),
acc AS (SELECT r, c, count(*) AS acc FROM walk GROUP BY 1, 2)"""


@query("flow_accumulation", _ACC + "SELECT r, c, acc FROM acc")
def _(spark, d):
    return H.flow_accumulation(H.d8_direction(_z(spark, d)), WIDTH)


def _hand(spark, d):
    flow = H.d8_direction(_z(spark, d))
    return H.hand(flow, H.flow_accumulation(flow, WIDTH), WIDTH, 5)


HAND_SQL = _ACC + """
, steps AS (SELECT r AS r0, c AS c0, r, c, 0 AS n FROM p UNION ALL SELECT r0, c0, p.to_r, p.to_c, n + 1 FROM steps JOIN p USING (r, c) WHERE p.to_r IS NOT NULL),
f AS (SELECT r0, c0, arg_min(cells.a, n) AS zc FROM steps JOIN acc USING (r, c) JOIN cells USING (r, c) WHERE acc >= 5 GROUP BY 1, 2),
hand AS (SELECT cells.r, cells.c, coalesce(greatest(0, a - zc), 0) AS hand FROM cells LEFT JOIN f ON r0 = cells.r AND c0 = cells.c)"""


@query("hand", HAND_SQL + "SELECT * FROM hand")
def _(spark, d):
    return _hand(spark, d)


@query("trace_downstream", _D8.replace("WITH", "WITH RECURSIVE", 1) + """
, walk AS (SELECT r * 100 + c AS start, 0 AS step, r, c FROM flow UNION ALL SELECT start, step + 1, to_r, to_c FROM walk JOIN flow USING (r, c) WHERE to_r IS NOT NULL) SELECT * FROM walk""")
def _(spark, d):
    flow = H.d8_direction(_z(spark, d))
    return H.trace_downstream(flow, WIDTH, flow)


@query("snap_to_channel", _ACC + "SELECT r, c, acc, greatest(abs(r - 50), abs(c - 50)) AS radius FROM acc WHERE acc > 6 AND greatest(abs(r - 50), abs(c - 50)) < 100 ORDER BY radius, acc DESC, r, c LIMIT 1")
def _(spark, d):
    return H.snap_to_channel(H.flow_accumulation(H.d8_direction(_z(spark, d)), WIDTH), 50, 50, 6)


@query("snap_polygons", _ACC + """
, v AS (SELECT p_partkey % 150 AS poly, p_partkey * 7 % 120 AS x, p_partkey * 13 % 120 AS y FROM part),
src AS (SELECT poly, r, c, acc FROM (SELECT poly, round_even(100 - avg(y), 0)::BIGINT AS r, round_even(avg(x), 0)::BIGINT AS c FROM v GROUP BY 1) JOIN acc USING (r, c)),
best AS (SELECT poly, min({'d': greatest(abs(a.r - src.r), abs(a.c - src.c)), 'n': -a.acc, 'r': a.r, 'c': a.c}) AS b FROM src JOIN acc a ON a.acc > 6 AND greatest(abs(a.r - src.r), abs(a.c - src.c)) < 10 GROUP BY 1)
SELECT poly, src.r, src.c, src.acc, b.r AS to_r, b.c AS to_c, b.d AS radius FROM src LEFT JOIN best USING (poly)""")
def _(spark, d):
    v = T.table(spark, d, "part").selectExpr("p_partkey % 150 AS poly", "double(p_partkey * 7 % 120) AS x", "double(p_partkey * 13 % 120) AS y")
    return H.snap_polygons(H.flow_accumulation(H.d8_direction(_z(spark, d)), WIDTH), v, x0=0.0, y0=100.0, step=1.0, threshold=6, most=10)


@query("channel_scaling", C + "SELECT r, c, round(least(1, a / 8848), 9) AS dem, round(greatest(0, least(1, (-b / 3 + 30) / 30)), 9) AS sar, round(10 * log10(greatest(a, 0) + 1e-10), 9) AS db FROM cells")
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    return rounded(T.cells(spark, d).select("r", "c", S.scale_channel(a, "dem").alias("dem"), S.scale_channel(-b / 3, "sar").alias("sar"), S.linear_to_db(a).alias("db")), "dem", "sar", "db")
