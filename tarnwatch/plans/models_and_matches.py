"""Registered queries of model jobs and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.operators import evaluation as E
from tarnwatch.operators import learning as L
from tarnwatch.operators import matching as M
from tarnwatch.plans import standins as T
from tarnwatch.plans.evaluations import rounded
from tarnwatch.plans.grids import _N

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("spatial_blocks")
def _(spark, d):
    return L.spatial_blocks(T.lakes(spark, d).withColumnRenamed("lake_id", "id")).select("id", "block")


@query("block_cv_classifier")
def _(spark, d):
    s = T.scores(spark, d).withColumns({"season": F.month("event_date").cast("double"), "id": F.col("sample_id")})
    return E.rank_auc(L.block_cv(s, ["score", "season"]), ["block"])


@query("residual_ridge")
def _(spark, d):
    s = T.surveys(spark, d).selectExpr("lake_id AS id", "lake_type", "area_km2 * 1e6 AS area", "volume_m3 AS truth", "0.104 * pow(area_km2 * 1e6, 1.421) AS law")
    fitted = L.residual_ridge(L.residual_features(s, "lake_type"), ["log_area"], "law", "truth")
    return E.ape_summary(fitted.select("lake_type", "truth", "estimate"), "lake_type")


@query("leakage_free_dataset")
def _(spark, d):
    metric = ((F.col("lon") - 80) * 98000).alias("x"), ((F.col("lat") - 27) * 110540).alias("y")
    events = T.catalogue(spark, d).select(F.col("event_id").alias("id"), "lat", "lon", *metric, (F.col("area_m2") / 1e6).alias("area_km2"), F.when(F.col("event_id") % 3 != 0, 4500.0).alias("elev_m"))
    lakes = T.lakes(spark, d).select(F.col("lake_id").alias("id"), "lat", "lon", *metric, (F.col("area_m2") / 1e6).alias("area_km2"), "elev_m")
    corners = T.surveys(spark, d).selectExpr("lake_id AS poly", "lake_id * 37 % 1500 * 980D AS w", "lake_id * 91 % 800 * 1100D AS s", "500 + area_km2 * 300 AS side").selectExpr("poly", "w", "s", "w + side AS e", "s + side AS n")
    glaciers = corners.selectExpr("poly", "stack(4, w, s, e, s, e, s, e, n, e, n, w, n, w, n, w, s) AS (x1, y1, x2, y2)")
    out = L.leakage_free_dataset(events, lakes, glaciers, negatives=lakes.count() // 3)
    return rounded(out, "log_area", "log_distance", "log_ice", digits=6)


@query("stacked_prior")
def _(spark, d):
    s = T.scores(spark, d).withColumns({"season": F.month("event_date").isin(6, 7, 8, 9).cast("double"), "year": F.year("event_date"), "id": F.col("sample_id")})
    middle = s.agg(F.percentile_approx(F.unix_date("event_date"), 0.5)).first()[0]
    found = L.stacked_prior(s, ["score"], ["score", "year", "season"], test=f"unix_date(event_date) >= {middle}", trees=2, depth=2)
    every = found.select("block", "label", F.expr("stack(2, 'stacked', stacked, 'plain', plain) AS (model, score)"))
    return E.rank_auc(every, ["model"])


@query("cross_calibrated")
def _(spark, d):
    s = T.scores(spark, d).select("sample_id", "block", "label", "score")
    isotonic = L.cross_calibrated(s, method="isotonic").select("sample_id", F.round("calibrated", 6).alias("isotonic"))
    return L.cross_calibrated(s).select("sample_id", "block", "label", F.round("calibrated", 6).alias("platt")).join(isotonic, "sample_id")


@query("ridge_leave_groups_out")
def _(spark, d):
    s = T.surveys(spark, d).selectExpr("lake_id AS id", "name", "lake_type", "region", "log(area_km2) AS log_area", "volume_m3 AS truth", "0.104 * pow(area_km2 * 1e6, 1.421) AS law")
    features, names = L.sparse_features(s, ["log_area"], {"lake_type": 1, "region": 5})
    return L.ridge_leave_groups_out(features, "name", len(names), "law", "truth").select("id", "truth", F.round("estimate", 3).alias("estimate"))


@query("score_lakes", T.with_("scores") + """
, b AS (SELECT score FROM scores WHERE block = 0), n AS (SELECT count(*) AS n FROM b)
SELECT sample_id AS id, score, round((SELECT count(*) FROM b WHERE b.score < scores.score) / (SELECT n FROM n), 9) AS percentile FROM scores WHERE block <> 0""")
def _(spark, d):
    s = T.scores(spark, d).selectExpr("sample_id AS id", "score", "block")
    return rounded(L.percentile_against(s.where("block <> 0").select("id", "score"), s.where("block = 0").select("score")), "percentile")


@query("batch_segmentation")
def _(spark, d):
    scorer = L.batch_scorer(lambda x: 1 / (1 + 2.718281828 ** (-x)), 64)
    return T.table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(scorer("embedding")), 4).alias("highest"))


@query("label_pair_join", """
WITH l AS (SELECT ts::DATE AS day, CASE day(ts) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS k FROM events),
b AS (SELECT day, min(k) AS k FROM l GROUP BY day), p AS (SELECT DISTINCT ts::DATE AS d1, (ts::DATE + 3)::DATE AS d2 FROM events)
SELECT d1 AS pair_id, ['gold', 'auto', 'merged'][x.k] AS tier_1, ['gold', 'auto', 'merged'][y.k] AS tier_2, CASE coalesce((x.k = 1)::INT, 0) + coalesce((y.k = 1)::INT, 0) WHEN 2 THEN 'complete' WHEN 1 THEN 'incomplete' ELSE 'missing' END AS gold
FROM p LEFT JOIN b x ON x.day = d1 LEFT JOIN b y ON y.day = d2""")
def _(spark, d):
    e = T.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    k = F.day("ts") % 4
    labels = e.select("day", F.when(k == 0, "gold").when(k == 1, "auto").when(k == 2, "merged").alias("tier"))
    pairs = e.select("day").distinct().select(F.col("day").alias("pair_id"), F.col("day").alias("d1"), F.date_add("day", 3).alias("d2"))
    return M.label_pairs(pairs, labels)


@query("eligible_pairs", f"""
SELECT pair_id, tier_1, tier_2, CASE WHEN tier_1 IS NULL OR tier_2 IS NULL OR day(pair_id) % 5 = 0 THEN 'missing' WHEN gold = 'complete' THEN 'complete' ELSE 'incomplete' END AS state FROM ({ORACLE_SQL["label_pair_join"]})""")
def _(spark, d):
    e = T.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    k = F.day("ts") % 4
    labels = e.select("day", F.when(k == 0, "gold").when(k == 1, "auto").when(k == 2, "merged").alias("tier"))
    uses = F.when(F.day("day") % 5 == 0, F.array(F.lit("train"))).otherwise(F.array(F.lit("train"), F.lit("eval")))
    pairs = e.select("day").distinct().select(F.col("day").alias("pair_id"), F.col("day").alias("d1"), F.date_add("day", 3).alias("d2"), uses.alias("uses"))
    return M.eligible_pairs(pairs, labels, "eval")


@query("catalogue_match_check", T.with_("surveys") + """
, s AS (SELECT lake_id AS id, name || CASE WHEN lake_id % 2 = 0 THEN ' Lake' ELSE '' END AS name, volume_m3 AS volume FROM surveys),
p AS (SELECT name, arg_max(volume_m3 * (0.5 + lake_id % 10 / 10.0::DOUBLE), lake_id) AS published FROM surveys GROUP BY name)
SELECT id, published, round((volume - published) / published * 100, 6) AS percent FROM s JOIN p ON p.name = replace(lower(s.name), ' lake', '')""")
def _(spark, d):
    s = T.surveys(spark, d)
    mine = s.selectExpr("lake_id AS id", "concat(name, IF(lake_id % 2 = 0, ' Lake', '')) AS name", "volume_m3 AS volume")
    return rounded(M.catalogue_matches(mine, s.selectExpr("lake_id AS seq", "name", "volume_m3 * (0.5D + lake_id % 10 / 10D) AS volume")), "percent", digits=6)


@query("exposure_view", T.with_("exposures") + "SELECT run_id, asset_id, line, p_name AS name, p_brand AS asset_class, distance_m FROM exposures JOIN part ON p_partkey = asset_id")
def _(spark, d):
    assets = T.table(spark, d, "part").selectExpr("p_partkey AS asset_id", "p_name AS name", "p_brand AS asset_class")
    return M.exposure_view(T.exposures(spark, d), assets)


@query("lut_bilinear", T.with_("cells") + """
, t AS (SELECT r AS line, c AS pixel, a AS value FROM cells WHERE r % 20 = 0 AND c % 25 = 0), m AS (SELECT max(line) AS ml, max(pixel) AS mp FROM t),
k AS (SELECT r, c, r // 20 * 20 AS r0, c // 25 * 25 AS c0, least(r // 20 * 20 + 20, ml) AS r1, least(c // 25 * 25 + 25, mp) AS c1 FROM cells, m),
f AS (SELECT *, CASE WHEN r1 > r0 THEN (r - r0) / 20.0::DOUBLE ELSE 0 END AS fr, CASE WHEN c1 > c0 THEN (c - c0) / 25.0::DOUBLE ELSE 0 END AS fc FROM k)
SELECT r, c, round((1 - fr) * (1 - fc) * q.value + (1 - fr) * fc * w.value + fr * (1 - fc) * e.value + fr * fc * u.value, 6) AS value FROM f JOIN t q ON q.line = r0 AND q.pixel = c0 JOIN t w ON w.line = r0 AND w.pixel = c1 JOIN t e ON e.line = r1 AND e.pixel = c0 JOIN t u ON u.line = r1 AND u.pixel = c1""")
def _(spark, d):
    c = T.cells(spark, d)
    return rounded(M.lut_bilinear(c, T.cells(spark, d).where("r % 20 = 0 AND c % 25 = 0").selectExpr("r AS line", "c AS pixel", "a AS value"), 20, 25), "value", digits=6)


@query("calibrate_scene", T.with_("cells") + """
, p AS (SELECT * FROM (VALUES ('vv', 1.0::DOUBLE), ('vh', 0.5::DOUBLE)) v(band, f)), t AS (SELECT band, r AS line, c AS pixel, (a + 1) * f AS value FROM cells, p WHERE r % 20 = 0 AND c % 25 = 0), m AS (SELECT max(line) AS ml, max(pixel) AS mp FROM t),
k AS (SELECT band, r, c, (coalesce(b, 0) + 1) * f AS dn, r // 20 * 20 AS r0, c // 25 * 25 AS c0, least(r // 20 * 20 + 20, ml) AS r1, least(c // 25 * 25 + 25, mp) AS c1 FROM cells, p, m),
f AS (SELECT *, CASE WHEN r1 > r0 THEN (r - r0) / 20.0::DOUBLE ELSE 0 END AS fr, CASE WHEN c1 > c0 THEN (c - c0) / 25.0::DOUBLE ELSE 0 END AS fc FROM k),
l AS (SELECT f.band, r, c, dn, (1 - fr) * (1 - fc) * q.value + (1 - fr) * fc * w.value + fr * (1 - fc) * e.value + fr * fc * u.value AS lut FROM f JOIN t q ON q.band = f.band AND q.line = r0 AND q.pixel = c0 JOIN t w ON w.band = f.band AND w.line = r0 AND w.pixel = c1 JOIN t e ON e.band = f.band AND e.line = r1 AND e.pixel = c0 JOIN t u ON u.band = f.band AND u.line = r1 AND u.pixel = c1),
d AS (SELECT *, 10 * log10(greatest(dn * dn / (lut * lut), 1e-10)) AS db FROM l)
""" + _N + """
, h AS (SELECT r, c, (-dx * sin(radians(35.0)) * sin(radians(100.0)) + dy * sin(radians(35.0)) * cos(radians(100.0)) + cos(radians(35.0))) / sqrt(dx * dx + dy * dy + 1) AS k FROM g)
SELECT band, r, c, round(CASE WHEN k > 0 THEN db - 10 * log10(greatest(k, 1e-3)) ELSE db END, 6) + 0 AS gamma FROM d JOIN h USING (r, c)""")
def _(spark, d):
    c = T.cells(spark, d)
    bands = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(f).alias("f")) for n, f in (("vv", 1.0), ("vh", 0.5))]))
    raw = c.select("r", "c", "a", F.coalesce("b", F.lit(0.0)).alias("b"), bands.alias("p")).select("p.band", "r", "c", ((F.col("a") + 1) * F.col("p.f")).alias("value"), ((F.col("b") + 1) * F.col("p.f")).alias("dn"))
    table = raw.where("r % 20 = 0 AND c % 25 = 0").selectExpr("band", "r AS line", "c AS pixel", "value")
    out = M.calibrated_scenes(raw.select("band", "r", "c", "dn"), table, c.selectExpr("r", "c", "a AS z"), ["band"], row_step=20, col_step=25, cell_m=30.0, incidence_deg=35.0, azimuth_deg=100.0)
    return rounded(out, "gamma", digits=6)


@query("region_metrics", T.with_("cells") + """
, m AS (SELECT (r // 10)::BIGINT AS region, count(*) FILTER (WHERE a > 50 AND b > 50) AS tp, count(*) FILTER (WHERE a <= 50 AND b > 50) AS fp, count(*) FILTER (WHERE a > 50 AND b <= 50) AS fn FROM cells GROUP BY 1)
SELECT region, round(tp / nullif(tp + fp + fn, 0), 9) AS iou, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall FROM m""")
def _(spark, d):
    c = T.cells(spark, d).withColumn("region", F.floor(F.col("r") / 10))
    return rounded(M.region_metrics(c, "region", F.col("a") > 50, F.col("b") > 50), "iou", "precision", "recall")


@query("change_metrics", T.with_("cells") + """
SELECT (r // 10)::BIGINT AS scene, count(*) FILTER (WHERE b > 60 AND a <= 60 AND b >= 50 AND a < 50) AS tp, count(*) FILTER (WHERE NOT (b > 60 AND a <= 60) AND b >= 50 AND a < 50) AS fp, count(*) FILTER (WHERE b > 60 AND a <= 60) AS labelled, round(sum(greatest(0, b / 100 - a / 100)), 6) AS positive_mass
FROM cells WHERE c % 4 <> 0 GROUP BY 1""")
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    c = T.cells(spark, d).withColumn("scene", F.floor(F.col("r") / 10))
    return rounded(M.change_metrics(c, ["scene"], a > 60, b > 60, a / 100, b / 100, F.col("c") % 4 != 0), "positive_mass", digits=6)
