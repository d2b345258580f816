"""Registered queries of spatial joins, samples, sources and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions import scalars as S
from tarnwatch.operators import sampling as M
from tarnwatch.operators import spatial as P
from tarnwatch.plans import standins as T
from tarnwatch.plans.evaluations import rounded
from tarnwatch.sources import readers as R
from tarnwatch.streaming import jobs

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


LC = T.with_("lakes", "catalogue")
_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(cos(radians(a.lat)) * cos(radians(a.lon)) - cos(radians(b.lat)) * cos(radians(b.lon)), 2) + pow(cos(radians(a.lat)) * sin(radians(a.lon)) - cos(radians(b.lat)) * sin(radians(b.lon)), 2) + pow(sin(radians(a.lat)) - sin(radians(b.lat)), 2)) / 2))"
_PAIRS = LC + f", pairs AS (SELECT a.lake_id AS id, b.event_id AS other, {_KM} AS km FROM lakes a, catalogue b WHERE abs(a.lat - b.lat) < 0.1 AND {_KM} <= 4)"


def _sides(spark, d):
    return T.lakes(spark, d).withColumnRenamed("lake_id", "id"), T.catalogue(spark, d).withColumnRenamed("event_id", "id")


@query("distance_range_join", _PAIRS + "SELECT id, other, round(km, 6) AS km FROM pairs")
def _(spark, d):
    return rounded(P.pairs_within(*_sides(spark, d), 4.0), "km", digits=6)


@query("nearest_within", _PAIRS + ", n AS (SELECT id, arg_min(other, (round(km, 9), other)) AS other, min(km) AS km FROM pairs GROUP BY id) SELECT lake_id AS id, other, round(km, 6) AS km FROM lakes LEFT JOIN n ON n.id = lake_id")
def _(spark, d):
    return rounded(P.nearest_within(*_sides(spark, d), 4.0), "km", digits=6)


@query("exclusion_anti_join", _PAIRS + "SELECT lake_id AS id FROM lakes WHERE lake_id NOT IN (SELECT id FROM pairs)")
def _(spark, d):
    return P.none_within(*_sides(spark, d), 4.0).select("id")


@query("known_lake_in_training", _PAIRS + "SELECT lake_id AS id, lake_id IN (SELECT id FROM pairs) AS known FROM lakes")
def _(spark, d):
    return P.any_within(*_sides(spark, d), 4.0)


@query("greedy_radius_clusters")
def _(spark, d):
    return P.greedy_radius_clusters(T.lakes(spark, d).withColumnRenamed("lake_id", "id"), 8.0)


@query("rasterize_polygons", LC + """
, poly AS (SELECT event_id AS poly, lon - 0.11 AS w, lon + 0.13 AS e, lat - 0.07 AS s, lat + 0.09 AS n FROM catalogue)
SELECT lake_id AS id, poly FROM lakes, poly WHERE lon >= w AND lon < e AND lat >= s AND lat < n""")
def _(spark, d):
    c = T.catalogue(spark, d).selectExpr("event_id AS poly", "lon - 0.11 AS w", "lon + 0.13 AS e", "lat - 0.07 AS s", "lat + 0.09 AS n")
    edges = c.selectExpr("poly", "stack(4, w, s, e, s, e, s, e, n, e, n, w, n, w, n, w, s) AS (x1, y1, x2, y2)")
    return P.polygon_parity(T.lakes(spark, d).selectExpr("lake_id AS id", "lon AS x", "lat AS y"), edges)


@query("clip_to_basin", T.with_("catalogue", "cells") + """
, poly AS (SELECT event_id AS poly, 10.25 + event_id * 7 % 60 AS w, 20.75 + event_id * 7 % 60 AS e, 3.25 AS s, 3.75 + event_id * 5 % 40 AS n FROM catalogue),
x AS (SELECT min(w) AS w, max(e) AS e, min(s) AS s, max(n) AS n FROM poly),
t AS (SELECT DISTINCT r, c, true AS inside FROM cells JOIN poly ON c >= w AND c < e AND r >= s AND r < n)
SELECT r, c, c::DOUBLE AS x, r::DOUBLE AS y, CASE WHEN inside THEN a END AS a FROM cells JOIN x ON c BETWEEN w AND e AND r BETWEEN s AND n LEFT JOIN t USING (r, c)""")
def _(spark, d):
    c = T.catalogue(spark, d).selectExpr("event_id AS poly", "10.25D + event_id * 7 % 60 AS w", "20.75D + event_id * 7 % 60 AS e", "3.25D AS s", "3.75D + event_id * 5 % 40 AS n")
    edges = c.selectExpr("poly", "stack(4, w, s, e, s, e, s, e, n, e, n, w, n, w, n, w, s) AS (x1, y1, x2, y2)")
    return P.clip_cells(T.cells(spark, d).selectExpr("r", "c", "CAST(c AS DOUBLE) AS x", "CAST(r AS DOUBLE) AS y", "a"), edges, "a", 1.0)


@query("scene_date_candidates", T.with_("catalogue", "observations") + """
, f AS (SELECT event_id AS want_id, observation_id AS scene_id, cloud_fraction AS cloud, abs(acquired_at - event_date)::INT AS off FROM catalogue JOIN observations ON acquired_at BETWEEN event_date - 7 AND event_date + 7)
SELECT *, row_number() OVER (PARTITION BY want_id ORDER BY cloud, off, scene_id)::INT AS rank FROM f QUALIFY rank <= 6""")
def _(spark, d):
    w = T.catalogue(spark, d).selectExpr("event_id AS want_id", "event_date AS day")
    s = T.observations(spark, d).selectExpr("observation_id AS scene_id", "cloud_fraction AS cloud", "acquired_at AS taken")
    return P.scene_date_candidates(w, s)


@query("scene_pair_pick", T.with_("observations") + """
, p AS (SELECT a.basin_id, a.observation_id AS first, b.observation_id AS second, a.acquired_at AS t1, b.acquired_at AS t2, abs((b.acquired_at - a.acquired_at) - 12)::INT AS off FROM observations a JOIN observations b ON a.basin_id = b.basin_id AND b.acquired_at - a.acquired_at BETWEEN 1 AND 30)
SELECT basin_id, arg_min(first, (off, t1, t2, first, second)) AS first, arg_min(second, (off, t1, t2, first, second)) AS second, min(off) AS off FROM p GROUP BY basin_id""")
def _(spark, d):
    return P.scene_pair_pick(T.observations(spark, d).selectExpr("basin_id", "observation_id AS scene_id", "acquired_at AS taken"), "basin_id", 12, 30)


@query("stratified_sample", T.with_("scores") + "SELECT id, block FROM (SELECT sample_id AS id, block, row_number() OVER (PARTITION BY block ORDER BY md5('3:' || sample_id), sample_id) AS k, floor(count(*) OVER (PARTITION BY block) * 0.3::DOUBLE + 0.5) AS quota FROM scores) WHERE k <= quota")
def _(spark, d):
    return M.stratified_sample(T.scores(spark, d).selectExpr("sample_id AS id", "block"), "block", 0.3, 3)


@query("stratified_parts", T.with_("scores") + """
, k AS (SELECT sample_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || sample_id), sample_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM scores)
SELECT id, label, CASE WHEN k <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'calibration' ELSE 'test' END AS part FROM k""")
def _(spark, d):
    return M.stratified_parts(T.scores(spark, d).selectExpr("sample_id AS id", "label"), "label", {"train": 0.6, "calibration": 0.2}, "test", 3)


@query("event_halves", T.with_("observations") + """
, e AS (SELECT basin_id, row_number() OVER (ORDER BY md5('3:' || basin_id), basin_id) AS k FROM (SELECT DISTINCT basin_id FROM observations))
SELECT observation_id, basin_id, CASE WHEN k % 2 = 1 THEN 'calibration' ELSE 'evaluation' END AS part FROM observations JOIN e USING (basin_id)""")
def _(spark, d):
    return M.event_halves(T.observations(spark, d).select("observation_id", "basin_id"), "basin_id", 3)


@query("named_holdout", T.with_("surveys") + "SELECT lake_id, region, CASE WHEN region IN ('Brand#11', 'Brand#23') THEN 'test' WHEN region = 'Brand#35' THEN 'val' ELSE 'train' END AS part FROM surveys")
def _(spark, d):
    return M.named_holdout(T.surveys(spark, d).select("lake_id", "region"), "region", {"test": ("Brand#11", "Brand#23"), "val": ("Brand#35",)})


@query("leaking_events", T.with_("surveys") + """
SELECT lake_type, count(DISTINCT CASE WHEN region IN ('Brand#11', 'Brand#23') THEN 'test' ELSE 'train' END) AS parts FROM surveys GROUP BY lake_type HAVING parts > 1""")
def _(spark, d):
    return M.leaking_events(M.named_holdout(T.surveys(spark, d), "region", {"test": ("Brand#11", "Brand#23")}), "lake_type")


_LAKE_CHIPS = ", chips AS (SELECT lake_id AS id, CASE WHEN lake_id % 5 = 0 THEN 'background' ELSE 'lake' END AS kind, lake_id * 7 % 90 AS row, lake_id * 11 % 40 AS positive, elev_m, area_m2 / 1e6 AS area_km2 FROM lakes)"


def _lake_chips(spark, d):
    return T.lakes(spark, d).selectExpr("lake_id AS id", "IF(lake_id % 5 = 0, 'background', 'lake') AS kind", "lake_id * 7 % 90 AS row", "lake_id * 11 % 40 AS positive", "elev_m", "area_m2 / 1e6D AS area_km2")


@query("band_split", T.with_("lakes") + _LAKE_CHIPS + """
, k AS (SELECT id, row_number() OVER (ORDER BY row, id) - 1 AS k, greatest(count(*) OVER () // 5, 1) AS size FROM chips WHERE kind = 'lake')
SELECT id, kind, row, CASE WHEN k // size = 4 OR k // size % 5 = 4 THEN 'val' ELSE 'train' END AS part FROM chips LEFT JOIN k USING (id)""")
def _(spark, d):
    return M.band_split(_lake_chips(spark, d).select("id", "kind", "row"))


@query("chip_report", T.with_("lakes") + _LAKE_CHIPS + """
SELECT kind, count(*) AS chips, count(*) FILTER (WHERE positive > 0) AS with_positive, median(positive) AS positive_median, max(positive) AS positive_max, min(elev_m) AS elev_m_min, median(elev_m) AS elev_m_median, max(elev_m) AS elev_m_max,
  min(area_km2) AS area_km2_min, round(median(area_km2), 9) AS area_km2_median, max(area_km2) AS area_km2_max FROM chips GROUP BY ROLLUP (kind)""")
def _(spark, d):
    return rounded(M.chip_report(_lake_chips(spark, d)), "area_km2_median")


@query("balanced_epoch", T.with_("scores") + """
, k AS (SELECT sample_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || sample_id), sample_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM scores),
z AS (SELECT label, max(n) AS n FROM k GROUP BY label), d AS (SELECT label, n, unnest(range(1, (SELECT max(n) FROM z) + 1)) AS draw FROM z)
SELECT k.id, d.label, d.draw FROM d JOIN k ON k.label = d.label AND k.k = ('0x' || substr(md5('3:' || d.label || ':' || d.draw), 1, 15))::BIGINT % d.n""")
def _(spark, d):
    return M.balanced_epoch(T.scores(spark, d).selectExpr("sample_id AS id", "label"), "label", 3)


@query("dataset_summary", T.with_("scores") + "SELECT block, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positive, count(DISTINCT sample_id) AS ids, round(avg((label = 1)::INT::DOUBLE), 9) AS share FROM scores GROUP BY ROLLUP (block)")
def _(spark, d):
    return rounded(M.dataset_summary(T.scores(spark, d), "block", "label", "sample_id"), "share")


@query("feature_statistics", T.with_("scores") + "SELECT block, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positive, count(DISTINCT sample_id) AS ids, round(avg((label = 1)::INT::DOUBLE), 9) AS share, round(avg(score) FILTER (WHERE label = 1), 9) AS score_mean, round(stddev_samp(score) FILTER (WHERE label = 1), 9) AS score_std FROM scores GROUP BY ROLLUP (block)")
def _(spark, d):
    return rounded(M.dataset_summary(T.scores(spark, d), "block", "label", "sample_id", ("score",)), "share", "score_mean", "score_std")


@query("power_law_fit", T.with_("surveys") + "SELECT lake_type, count(*) AS n, round(regr_slope(ln(volume_m3), ln(area_km2)), 6) AS exponent, round(exp(regr_intercept(ln(volume_m3), ln(area_km2))), 3) AS factor FROM surveys WHERE area_km2 > 0 AND volume_m3 > 0 GROUP BY 1")
def _(spark, d):
    p = M.power_law(T.surveys(spark, d).selectExpr("lake_type", "area_km2 AS area", "volume_m3 AS volume"), ["lake_type"], (0.104, 1.421))
    return rounded(rounded(p, "exponent", digits=6), "factor", digits=3)


@query("grouped_loo", T.with_("surveys") + ", g AS (SELECT DISTINCT lake_type AS held FROM surveys) SELECT held AS lake_type, count(*) AS n, round(regr_slope(ln(volume_m3), ln(area_km2)), 6) AS exponent, round(exp(regr_intercept(ln(volume_m3), ln(area_km2))), 2) AS factor FROM g JOIN surveys ON lake_type <> held WHERE area_km2 > 0 AND volume_m3 > 0 GROUP BY held")
def _(spark, d):
    p = M.grouped_leave_one_out(T.surveys(spark, d).selectExpr("lake_type", "area_km2 AS area", "volume_m3 AS volume"), "lake_type")
    return rounded(rounded(p, "exponent", digits=6), "factor", digits=2)


@query("region_and_volume", T.with_("lakes") + """
SELECT lake_id, CASE WHEN lat < 28.5 AND lon < 82 THEN 'Western Himalaya' WHEN lat < 28.5 AND lon < 89 THEN 'Central Himalaya' WHEN lat < 28.5 THEN 'Eastern Himalaya' WHEN lat < 33 AND lon < 78 THEN 'Western Himalaya' WHEN lat < 33 AND lon < 85 THEN 'Central Himalaya'
  WHEN lat < 33 THEN 'Tibetan Plateau' WHEN lat < 39 AND lon < 75 THEN 'Hindu Kush' WHEN lat < 39 AND lon < 80 THEN 'Karakoram' WHEN lat < 39 THEN 'Pamir' ELSE 'Tien Shan' END AS region, round(greatest(5, least(45, 12 + (elev_m - 3000) * 0.008)), 6) AS slope,
  round(0.104 * pow(area_m2, 1.421), 3) AS volume, (floor((lon + 180) / 6) + 1)::INT AS zone, CASE WHEN area_m2 / 1e6 < 0.05 THEN 'micro' WHEN area_m2 / 1e6 < 0.5 THEN 'medium' ELSE 'large' END AS bin FROM lakes""")
def _(spark, d):
    out = T.lakes(spark, d).select("lake_id", S.region_of(F.col("lat"), F.col("lon")).alias("region"), F.round(S.proxy_slope(F.col("elev_m")), 6).alias("slope"), F.round(S.area_volume(F.col("area_m2")), 3).alias("volume"), S.utm_zone(F.col("lon")).alias("zone"), S.area_bin(F.col("area_m2") / 1e6).alias("bin"))
    return out


@query("asset_class", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'settlement' WHEN p_partkey % 4 = 0 THEN 'bridge' WHEN p_partkey % 5 = 0 THEN 'well' WHEN p_partkey % 7 = 0 THEN 'road' ELSE 'other' END AS kind,
  CASE WHEN p_partkey % 4 = 0 THEN 75.0 WHEN p_partkey % 7 = 0 THEN 50.0 ELSE 100.0 END::DOUBLE AS buffer FROM part""")
def _(spark, d):
    k = F.col("p_partkey")
    tags = F.map_filter(F.create_map(F.lit("place"), F.when(k % 6 == 0, "village"), F.lit("bridge"), F.when(k % 4 == 0, "yes"), F.lit("man_made"), F.when(k % 5 == 0, "water_well"), F.lit("highway"), F.when(k % 7 == 0, "path")), lambda _, v: v.isNotNull())
    p = T.table(spark, d, "part").select(k.alias("id"), tags.alias("tags"))
    return p.select("id", S.asset_type(F.col("tags")).alias("kind"), S.asset_buffer(F.col("tags")).alias("buffer"))


@query("calibrated_scores", T.with_("scores") + """
, s AS (SELECT sample_id, score, 1 / (1 + exp(-(score * 3 - 1))) AS platt, CASE WHEN score <= 0.2 THEN 0.05 WHEN score <= 0.6 THEN 0.05 + (score - 0.2) * 0.875 WHEN score <= 0.9 THEN 0.4 + (score - 0.6) * (0.5 / 0.3) ELSE 0.9 END AS piecewise FROM scores),
o AS (SELECT *, greatest(1e-4, least(1 - 1e-4, score)) AS s0, greatest(1e-4, least(1 - 1e-4, platt)) AS d0 FROM s), q AS (SELECT *, s0 / (1 - s0) * (d0 / (1 - d0)) / (0.25 / 0.75) AS odds FROM o)
SELECT sample_id, round(platt, 6) AS platt, round(piecewise, 6) AS piecewise, round(odds / (1 + odds), 6) AS posterior FROM q""")
def _(spark, d):
    p = S.platt(F.col("score"), 3.0, -1.0)
    out = T.scores(spark, d).select("sample_id", p.alias("platt"), S.interpolate(F.col("score"), [(0.2, 0.05), (0.6, 0.4), (0.9, 0.9)]).alias("piecewise"), S.odds_update(p, F.col("score"), 0.25).alias("posterior"))
    return rounded(out, "platt", "piecewise", "posterior", digits=6)


@query("lake_inventory", T.with_("lakes") + "SELECT lake_id, lat, lon, elev_m, area_m2 / 1e6 AS area_km2 FROM lakes WHERE elev_m >= 4000 AND area_m2 >= 20000")
def _(spark, d):
    return R.lake_inventory(T.lakes(spark, d), 4000, 0.02)


@query("raster_cells", T.with_("cells") + "SELECT r, c, a, b FROM cells WHERE c <= (SELECT max(c) FROM cells) AND r % 2 = 0 AND c % 2 = 0")
def _(spark, d):
    """The whole grid at half its resolution, as an overview is read."""
    h, w = T.shape(spark, d)
    return R.raster_cells(T.cells(spark, d), (0, h - 1, 0, w - 1), 2)


@query("weather_archive_rows", T.with_("weather") + "SELECT station, day, precip, tmean, tmin, tmax FROM weather")
def _(spark, d):
    names = {"time": F.col("day").cast("string"), "precipitation_sum": F.col("precip"), "temperature_2m_mean": F.col("tmean"), "temperature_2m_min": F.col("tmin"), "temperature_2m_max": F.col("tmax")}
    rows = T.weather(spark, d).groupBy("station").agg(F.sort_array(F.collect_list(F.struct(*[v.alias(k) for k, v in names.items()]))).alias("x"))
    docs = rows.select(F.to_json(F.struct("station", F.struct(*[F.col(f"x.{k}").alias(k) for k in names]).alias("daily"))).alias("json"))
    return R.weather_archive_rows(docs)


@query("new_scene_stream", T.with_("observations") + "SELECT source, (observation_id % 4000)::VARCHAR AS scene_id, min(acquired_at) AS taken FROM observations WHERE observation_id % 4000 >= 1000 GROUP BY 1, 2")
def _(spark, d):
    o = T.observations(spark, d).selectExpr("source", "cast(observation_id % 4000 AS string) AS scene_id", "acquired_at AS taken", "cast(observation_id AS string) AS href", "observation_id")
    known = o.where("observation_id % 4000 < 1000").select("source", "scene_id").distinct()
    return jobs.new_scenes(o, known).select("source", "scene_id", "taken")


@query("job_state_stream", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, count(*) AS attempts, CASE WHEN arg_max(event_type, event_id) = 'error' THEN arg_max(props, event_id) END AS last_error, arg_max(props, event_id) FILTER (WHERE event_type = 'purchase') AS path FROM events GROUP BY 1")
def _(spark, d):
    e = T.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("path"))
    return jobs.job_states(e)


@query("report_sink", T.with_("surveys") + "SELECT lake_type, count(*) AS n, sum(lake_id)::BIGINT AS items FROM surveys GROUP BY 1")
def _(spark, d):
    r = R.report(T.surveys(spark, d), "lake_type", "lake_id", most=10).select("lake_type", F.from_json("report", "n long, part int, items array<long>").alias("r"))
    items = F.aggregate("r.items", F.lit(0).cast("long"), lambda a, x: a + x)
    return r.groupBy("lake_type").agg(F.max("r.n").alias("n"), F.sum(items).alias("items"))
