"""Registered queries of readers and typed tables, and of small operators on runs, places and weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions import scalars as S
from tarnwatch.operators import learning, matching, sampling, scoring, spatial, terrain, weather
from tarnwatch.operators import grid as G
from tarnwatch.plans import grids
from tarnwatch.plans import standins as T
from tarnwatch.plans.evaluations import rounded
from tarnwatch.sources import keyed as K
from tarnwatch.sources import readers as R
from tarnwatch.sources import tables as B

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("weather_power_rows", T.with_("weather") + "SELECT station, day, precip, CASE WHEN tmean < 42 THEN tmean END AS tmean, tmin, tmax FROM weather")
def _(spark, d):
    w = T.weather(spark, d).withColumn("tmean", F.when(F.col("tmean") < 42, F.col("tmean")).otherwise(-999.0))
    names = {"PRECTOTCORR": "precip", "T2M": "tmean", "T2M_MIN": "tmin", "T2M_MAX": "tmax"}
    series = [F.map_from_entries(F.collect_list(F.struct(F.date_format("day", "yyyyMMdd").alias("key"), F.col(c).alias("value")))).alias(k) for k, c in names.items()]
    return R.weather_power_rows(w.groupBy("station").agg(*series).select("station", F.to_json(F.struct(*names)).alias("json")))


@query("date_map_series", T.with_("weather") + "SELECT station, day, tmean, tmin FROM weather")
def _(spark, d):
    return R.date_map_series(R.date_map_documents(T.weather(spark, d)))


@query("osm_features", T.with_("lakes") + "SELECT lake_id AS id, CASE lake_id % 5 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' ELSE 'LineString' END AS shape FROM lakes WHERE lake_id % 5 < 3")
def _(spark, d):
    k, at = F.col("lake_id") % 5, lambda i: F.struct((F.col("lon") + i % 3).alias("lon"), (F.col("lat") + i % 2).alias("lat"))
    lines = F.when(k == 1, F.array(*[at(i) for i in (0, 1, 2, 0)])).when(k == 2, F.array(at(0), at(1))).when(k == 3, F.array(at(0)))
    rows = T.lakes(spark, d).select(F.col("lake_id").alias("id"), F.when(k.isin(0, 4), "node").otherwise("way").alias("kind"), F.when(k == 0, F.col("lat")).alias("lat"), F.when(k == 0, F.col("lon")).alias("lon"), lines.alias("geometry"), F.create_map(F.lit("place"), F.lit("hamlet")).alias("tags"))
    return R.osm_elements_to_features(rows).select("id", "shape")


@query("geojson_features", T.with_("lakes") + "SELECT 'Point' AS shape, lon, lat, lake_id AS id FROM lakes")
def _(spark, d):
    feature = F.struct(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.col("lake_id").cast("string").alias("id")).alias("properties"))
    documents = T.lakes(spark, d).groupBy(F.col("lake_id") % 20).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("json"))
    return R.geojson_feature_rows(documents).select("shape", "lon", "lat", F.col("properties")["id"].cast("long").alias("id"))


@query("stac_items", T.with_("observations") + """
SELECT 's' || observation_id AS scene_id, CASE observation_id % 3 WHEN 0 THEN 'd' || observation_id WHEN 1 THEN 'p' || observation_id END AS href, CASE WHEN observation_id % 2 = 0 THEN 'ascending' ELSE 'DESCENDING' END AS orbit,
  CASE WHEN observation_id % 5 = 0 THEN 'SLC' ELSE 'GRD' END AS product, 'VV' AS polarisation FROM observations""")
def _(spark, d):
    k = F.col("observation_id")
    prop = F.map_filter(F.create_map(F.lit("sat:orbit_state"), F.when(k % 2 == 0, "ascending"), F.lit("orbitDirection"), F.when(k % 2 != 0, "DESCENDING"), F.lit("productType"), F.when(k % 5 == 0, "SLC")), lambda _, v: v.isNotNull())
    link = lambda p: F.struct(F.concat(F.lit(p), k.cast("string")).alias("href"))
    assets = F.when(k % 3 == 0, F.create_map(F.lit("data"), link("d"))).when(k % 3 == 1, F.create_map(F.lit("product"), link("p"))).otherwise(F.create_map(F.lit("thumbnail"), link("t")))
    return matching.stac_item_rows(T.observations(spark, d).select(F.to_json(F.struct(F.concat(F.lit("s"), k.cast("string")).alias("id"), prop.alias("properties"), assets.alias("assets"))).alias("json")))


@query("event_catalogue", T.with_("catalogue") + """
SELECT lat, lon, event_date, CASE WHEN event_id % 5 <> 0 THEN area_m2 / 1e6 END AS area_km2, 1 AS breached FROM catalogue WHERE event_id % 7 <> 0 AND event_id % 11 <> 0""")
def _(spark, d):
    k, day = F.col("event_id"), F.col("event_date")
    rows = T.catalogue(spark, d).select(
        F.when(k % 11 != 0, F.col("lat").cast("string")).otherwise("none").alias("lat"), F.col("lon").cast("string").alias("lon"), F.year(day).cast("string").alias("year"),
        F.when(k % 7 == 0, "13").otherwise(F.month(day).cast("string")).alias("month"), F.day(day).cast("string").alias("day"), F.when(k % 5 == 0, "?").otherwise(F.col("area_m2").cast("string")).alias("area"),
    )
    return R.event_catalogue_rows(rows)


@query("complete_samples", "SELECT 's' || doc_id AS sample FROM documents WHERE doc_id % 3 <> 0")
def _(spark, d):
    k = F.col("doc_id")
    fields = F.explode(F.when(k % 3 == 0, F.array(F.lit("tif"), F.lit("txt"))).otherwise(F.array(F.lit("tif"), F.lit("json")))).alias("field")
    members = T.table(spark, d, "documents").select(k, fields).select(F.concat(F.lit("shards/a/s"), k.cast("string"), F.lit("."), "field").alias("path"))
    return R.complete_samples(members, ["tif", "json"])


@query("tile_list", T.with_("catalogue") + """
SELECT event_id AS box, a::INT AS lat, o::INT AS lon, 'N' || lpad(a::VARCHAR, 2, '0') || 'E' || lpad(o::VARCHAR, 3, '0') AS tile
FROM (SELECT event_id, a, unnest(range(floor(lon - 0.6)::BIGINT, floor(lon + 0.7)::BIGINT + 1)) AS o FROM (SELECT event_id, lon, unnest(range(floor(lat - 0.3)::BIGINT, floor(lat + 0.4)::BIGINT + 1)) AS a FROM catalogue))""")
def _(spark, d):
    return R.tile_list(T.catalogue(spark, d).selectExpr("event_id AS box", "lat - 0.3D AS south", "lat + 0.4D AS north", "lon - 0.6D AS west", "lon + 0.7D AS east"))


@query("granule_list", T.with_("catalogue") + """
SELECT event_id AS span, day::DATE AS day, 'rain.' || strftime(day, '%Y.%j') AS granule FROM (SELECT event_id, unnest(generate_series(event_date::TIMESTAMP, (event_date + (event_id % 9 - 2)::INT)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM catalogue WHERE event_id % 9 >= 2)""")
def _(spark, d):
    return R.granule_list(T.catalogue(spark, d).selectExpr("event_id AS span", "event_date AS first", "date_add(event_date, int(event_id % 9 - 2)) AS last"), "rain.")


@query("operational_dispatches", """
SELECT event_id::VARCHAR AS dispatch_id, event_id % 500 AS bytes, (event_id % 7 = 0)::INT + (event_id % 500 > 250)::INT + 2 * (event_id % 13 = 0)::INT - (event_id % 13 = 0 AND event_id % 500 > 250)::INT AS broken FROM events""")
def _(spark, d):
    k = F.col("event_id")
    texts = [(k % 500).cast("string").alias(c) for c in ("alert_id", "geofence_id", "payload", "channel", "recipient_group")]
    json = F.to_json(F.struct(k.cast("string").alias("dispatch_id"), F.when(k % 7 != 0, F.col("user_id").cast("string")).alias("review_id"), F.when(k % 13 != 0, k % 500).alias("payload_bytes"), *texts))
    rows = B.operational_rows(T.table(spark, d, "events").select(json.alias("json")), "dispatches")
    return rows.select("dispatch_id", F.col("channel").cast("long").alias("bytes"), F.size("broken").alias("broken"))


@query("broken_rules", """
WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'reject' ELSE 'postpone' END AS decision FROM events),
s AS (SELECT DISTINCT 's' || user_id AS score_id, (user_id % 12) / 10.0::DOUBLE AS confidence FROM e WHERE user_id % 10 <> 0),
x AS (SELECT 'd' || event_id AS id, CASE WHEN event_id % 35 = 0 THEN 'none' ELSE event_id::VARCHAR END AS review, event_id % 300 AS bytes FROM e WHERE event_id % 5 = 0),
j AS (SELECT 'j' || event_id AS id, user_id, min('j' || event_id) OVER (PARTITION BY user_id) AS first FROM e)
SELECT 'scores' AS "table", score_id AS key, 'confidence BETWEEN 0 AND 1' AS rule FROM s WHERE confidence > 1
UNION ALL SELECT 'reviews', event_id::VARCHAR, 'score_id is not in scores' FROM e WHERE user_id % 10 = 0
UNION ALL SELECT 'dispatches', id, 'payload_bytes <= 250' FROM x WHERE bytes > 250
UNION ALL SELECT 'dispatches', id, 'review_id is not in reviews' FROM x WHERE review = 'none'
UNION ALL SELECT 'dispatches', id, 'review is not a confirmation' FROM x JOIN e ON review = event_id::VARCHAR WHERE decision <> 'confirm'
UNION ALL SELECT 'acquisition_jobs', id, '(source, provider_product_id) is not unique' FROM j WHERE id > first""")
def _(spark, d):
    e = T.table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "reject").otherwise("postpone").alias("decision"))
    rows = {
        "scores": e.where("user_id % 10 <> 0").select("user_id").distinct().selectExpr("concat('s', user_id) AS score_id", "'r' AS run_id", "0.5D AS hazard_score", "0.5D AS exposure_priority", "user_id % 12 / 10D AS confidence", "'watch' AS severity", "'[]' AS reasons_json"),
        "reviews": e.selectExpr("string(event_id) AS review_id", "concat('s', user_id) AS score_id", "'r' AS reviewer", "decision"),
        "dispatches": e.where("event_id % 5 = 0").selectExpr("concat('d', event_id) AS dispatch_id", "IF(event_id % 35 = 0, 'none', string(event_id)) AS review_id", "int(event_id % 300) AS payload_bytes", *[f"'x' AS {c}" for c in ("alert_id", "geofence_id", "payload", "channel", "recipient_group")]),
        "acquisition_jobs": e.selectExpr("concat('j', event_id) AS job_id", "'s1' AS source", "string(user_id) AS provider_product_id", "'ready' AS status"),
    }
    return K.broken_rules(rows)


_SURVEY_SQL = """
WITH s AS (SELECT 'Lake-' || p_size AS lake, CASE WHEN p_size % 4 <> 0 THEN DATE '2020-01-01' + p_size::INT END AS surveyed, 27 + p_partkey % 100 / 50.0::DOUBLE AS lat, 84 + p_partkey % 70 / 2.0::DOUBLE AS lon, p_partkey % 40 - 4.0::DOUBLE AS depth FROM part WHERE p_partkey % 6 <> 0),
k AS (SELECT * FROM s WHERE depth > 0 AND lon BETWEEN 80 AND 105 AND lat BETWEEN 25 AND 36)"""


@query("survey_records", _SURVEY_SQL + "SELECT lake, surveyed, count(*) AS points, max(depth) AS deepest, round(avg(depth), 9) AS mean_depth, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM k GROUP BY 1, 2")
def _(spark, d):
    """Three layouts of headers, one of them without a depth."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    stamp = F.when(size % 4 != 0, F.concat(F.lit("_"), F.date_format(F.date_add(F.to_date(F.lit("2020-01-01")), size), "yyyyMMdd"))).otherwise("")
    text = lambda c: c.cast("string")
    lat, lon, depth = text(27 + k % 100 / F.lit(50.0)), text(84 + k % 70 / F.lit(2.0)), text((k % 40 - 4).cast("double"))
    names = lambda *n: F.create_map(*[x for pair in zip(map(F.lit, n), (lat, lon, depth), strict=False) for x in pair])
    fields = F.when(k % 6 == 0, names("Latitude", "Longitude", "Remark")).when(k % 2 == 0, names("LAT_dd", "Lon_dd", "Depth (m)")).otherwise(names("latitude", "longitude", "water depth"))
    rows = T.table(spark, d, "part").select(F.concat(F.lit("surveys/Lake-"), size.cast("string"), stamp, F.lit(".csv")).alias("file"), fields.alias("fields"))
    return rounded(B.survey_records(B.survey_points(rows)), "mean_depth")


@query("published_lakes", T.with_("surveys") + "SELECT lake_type, name, area_km2, volume_m3, CASE WHEN lake_id % 4 <> 3 THEN (1990 + lake_id % 30)::INT END AS year FROM surveys WHERE lake_id % 9 <> 0")
def _(spark, d):
    k, year = F.col("lake_id"), (1990 + F.col("lake_id") % 30).cast("string")
    text = F.when(k % 4 == 0, year).when(k % 4 == 1, F.concat(year, F.lit(".0"))).when(k % 4 == 2, F.concat(F.lit("about "), year, F.lit(" (sonar)"))).otherwise("unknown")
    rows = T.surveys(spark, d).select("lake_type", F.concat(F.lit(" "), "name").alias("name"), F.col("area_km2").cast("string").alias("area"), F.when(k % 9 == 0, "n/a").otherwise(F.col("volume_m3").cast("string")).alias("volume"), text.alias("year"))
    return B.published_lakes(rows)


@query("photon_tracks", """
SELECT o_custkey AS track, count(*) AS points, max(o_orderkey % 23 - 3.0::DOUBLE) AS deepest, round(avg(o_orderkey % 23 - 3.0::DOUBLE), 9) AS mean_depth, min(27 + o_orderkey % 90 / 30.0::DOUBLE) AS min_lat, max(27 + o_orderkey % 90 / 30.0::DOUBLE) AS max_lat,
  min(80 + o_orderkey % 50 / 10.0::DOUBLE) AS min_lon, max(80 + o_orderkey % 50 / 10.0::DOUBLE) AS max_lon FROM orders WHERE o_orderkey % 23 > 3 AND o_orderkey % 8 <> 0 GROUP BY 1""")
def _(spark, d):
    p = T.table(spark, d, "orders").selectExpr("o_custkey AS track", "IF(o_orderkey % 8 = 0, double('NaN'), 27 + o_orderkey % 90 / 30D) AS lat", "80 + o_orderkey % 50 / 10D AS lon", "o_orderkey % 23 - 3D AS depth")
    return rounded(B.photon_tracks(p), "mean_depth")


@query("chip_splits", "SELECT 'i' || doc_id AS image, 'l' || doc_id AS label, CASE WHEN doc_id % 2 = 0 THEN ['train', 'valid', 'test'][doc_id % 3 + 1] ELSE ['train', 'valid', 'test'][doc_id % 5 % 3 + 1] END AS split FROM documents WHERE doc_id % 7 <> 0")
def _(spark, d):
    k = F.col("doc_id")
    name = lambda i: F.when(i == 0, "train").when(i == 1, "valid").otherwise("test")
    both = F.concat(F.lit("i"), k.cast("string"), F.lit(", l"), k.cast("string"))
    line = F.when(k % 7 == 0, F.concat(F.lit("i"), k.cast("string"))).when(k % 2 == 0, F.concat(both, F.lit(","), name(k % 3))).otherwise(both)
    return B.chip_split_rows(T.table(spark, d, "documents").select(F.concat(F.lit("splits/"), name(k % 5 % 3), F.lit("_rows.csv")).alias("file"), line.alias("line")))


@query("provenance_rows", """
SELECT 'f' || user_id AS path, max(ts) AS acquired_at, sum(event_id % 3)::BIGINT AS retries, arg_max(event_type, (ts, event_id)) AS source, 'box' AS bbox, arg_max('s' || event_id, (ts, event_id)) AS scene_id, arg_max('u' || event_id, (ts, event_id)) AS url, arg_max(event_id, (ts, event_id)) AS records FROM events GROUP BY 1""")
def _(spark, d):
    e = T.table(spark, d, "events")
    rows = e.selectExpr("concat('f', user_id) AS path", "event_type AS source", "'box' AS bbox", "ts AS acquired_at", "event_id % 3 AS retries", "concat('s', event_id) AS scene_id", "concat('u', event_id) AS url", "event_id AS records")
    return B.provenance_rows(rows.where("records % 2 = 0"), rows.where("records % 2 = 1"))


@query("hand_exposure", grids.HAND_SQL + ", pt AS (SELECT c_custkey AS id, c_custkey * 7 % 120 AS r, c_custkey * 11 % 120 AS c FROM customer) SELECT id, coalesce(hand <= 5, false) AS exposed FROM pt LEFT JOIN hand USING (r, c)")
def _(spark, d):
    k = F.col("c_custkey")
    p = T.table(spark, d, "customer").select(k.alias("id"), (k * 7 % 120).alias("r"), (k * 11 % 120).alias("c"))
    return terrain.hand_exposure(p, grids._hand(spark, d), 5.0)


@query("hand_filter", grids.HAND_SQL + "SELECT r, c, CASE WHEN hand > 15 THEN 0 ELSE b / 100 END AS p FROM hand JOIN cells USING (r, c)")
def _(spark, d):
    return terrain.hand_filter(T.cells(spark, d).select("r", "c", (F.col("b") / 100).alias("p")), grids._hand(spark, d))


@query("arrival_horizons", T.with_("surveys") + """
, s AS (SELECT unnest([{'o': 1, 'n': 'a', 'm': 20}, {'o': 2, 'n': 'steel', 'm': 40}, {'o': 3, 'n': 'brass', 'm': 60}]) AS s), n AS (SELECT lake_id AS id, lower(lake_type) AS name FROM surveys)
SELECT id, arg_min(s.m, s.o) AS minutes, count(s.m) > 0 AS available FROM n LEFT JOIN s ON contains(name, s.n) OR contains(s.n, name) GROUP BY 1""")
def _(spark, d):
    sectors = spark.createDataFrame([(1, "A", 20), (2, "STEEL", 40), (3, "Brass", 60)], "id int, name string, minutes int")
    return spatial.arrival_horizons(T.surveys(spark, d).selectExpr("lake_id AS id", "lake_type AS name"), sectors)


@query("volume_estimates", T.with_("lakes") + """
SELECT lake_id AS id, round(CASE WHEN lake_id % 3 = 0 THEN lake_id * 1000.0::DOUBLE WHEN lake_id % 3 = 1 THEN area_m2 * (lake_id % 30) ELSE 0.104::DOUBLE * pow(area_m2, 1.421) END, 3) AS volume, CASE lake_id % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'surveyed' ELSE 'law' END AS source FROM lakes""")
def _(spark, d):
    k = F.col("lake_id")
    lakes = T.lakes(spark, d).select(k.alias("id"), F.when(k % 3 != 2, (k % 30).cast("double")).alias("mean_depth"), "area_m2")
    return rounded(matching.volume_estimates(lakes, T.lakes(spark, d).where("lake_id % 3 = 0").select(k.alias("id"), (k * 1000.0).alias("published"))), "volume", digits=3)


#: CRC-32 of a short ASCII text, by the rule, as DuckDB has no such function.
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0,1,2,3,4,5,6,7]::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i)))"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen({text})), lambda j: ascii(substr({text}, (j + 1)::BIGINT, 1))::UBIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"


@query("within_lake_negatives", T.with_("catalogue") + f"""
, {_CRC_TABLE}, e AS (SELECT event_id % 40 AS site, event_date FROM catalogue), t AS (SELECT site, k, '5:' || site || ':' || k AS text FROM (SELECT DISTINCT site FROM e), (SELECT unnest(range(1, 13)) AS k)),
c AS (SELECT site, k, DATE '1990-01-01' + ({_crc("text")} % 3650)::INT AS day FROM t, crc_table), f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.site = c.site AND abs(c.day - e.event_date) <= 120))
SELECT site, day FROM (SELECT site, day, row_number() OVER (PARTITION BY site ORDER BY k) AS n FROM f) WHERE n <= 3""")
def _(spark, d):
    e = T.catalogue(spark, d).selectExpr("event_id % 40 AS site", "event_date")
    return sampling.negative_dates(e.select("site").distinct(), e, 3, 120, 12, 3650, 5)


@query("seasonal_negative_dates", T.with_("lakes", "catalogue") + f"""
, {_CRC_TABLE}, p AS (SELECT event_id, event_date, {_crc("event_id::VARCHAR")} % 64 AS slot FROM catalogue, crc_table),
k AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY slot) AS n FROM p), s AS (SELECT slot, n, row_number() OVER (ORDER BY slot) - 1 AS i FROM (SELECT DISTINCT slot, n FROM k)),
h AS (SELECT lake_id AS site, {_crc("('9:' || lake_id)")} AS h FROM lakes, crc_table), q AS (SELECT site, h // 64 AS v, h % (SELECT count(*) FROM s) AS i FROM h)
SELECT site, event_date FROM q JOIN s USING (i) JOIN k ON k.slot = s.slot AND k.k = v % s.n""")
def _(spark, d):
    return matching.seasonal_negative_dates(T.lakes(spark, d).selectExpr("lake_id AS site"), T.catalogue(spark, d), 9)


@query("sample_frame", T.with_("lakes", "catalogue") + "SELECT lat, lon, area_m2, 'breached' AS kind, event_date, NULL::DOUBLE AS elev_m FROM catalogue UNION ALL SELECT lat, lon, area_m2, 'stable', NULL, elev_m FROM lakes")
def _(spark, d):
    return sampling.sample_frame({"breached": T.catalogue(spark, d).drop("event_id"), "stable": T.lakes(spark, d).drop("lake_id")}).select("lat", "lon", "area_m2", "kind", "event_date", "elev_m")


_EVIDENCE = ("o_orderkey % 2 = 0 AS promoted", "o_orderkey % 3 > 0 AS descending", "o_orderkey % 5 > 0 AS covers", "o_orderkey % 7 > 0 AS in_scope", "o_orderkey % 11 = 0 AS frozen")


@query("select_expansion", f"""
WITH e AS (SELECT o_orderkey AS run_id, {", ".join(_EVIDENCE)}, o_orderkey % 4 / 2.0::DOUBLE AS base, o_custkey % 9 - 1.0::DOUBLE AS grown, o_orderkey % 40 / 1.0::DOUBLE AS registered FROM orders),
g AS (SELECT *, promoted AND descending AND covers AND in_scope AND NOT frozen AND base > 0 AS ok FROM e)
SELECT run_id, ok AS from_model, round(CASE WHEN ok THEN grown / base * 100 ELSE registered END, 6) AS expansion, round(CASE WHEN ok THEN grown / base * 80 END, 6) AS low, round(CASE WHEN ok THEN grown / base * 120 END, 6) AS high, coalesce(CASE WHEN ok THEN grown / base * 80 END <= 0, false) AS uncertain FROM g""")
def _(spark, d):
    e = T.table(spark, d, "orders").selectExpr("o_orderkey AS run_id", *_EVIDENCE, "o_orderkey % 4 / 2D AS baseline_km2", "o_custkey % 9 - 1D AS expansion_km2", "o_orderkey % 40 / 1D AS registered")
    return rounded(scoring.select_expansion(e, 0.2), "expansion", "low", "high", digits=6)


@query("frozen_suppression", T.with_("weather") + "SELECT station, day, NOT (tmean < 38 OR tmean BETWEEN 38 AND 40) AS reliable FROM weather")
def _(spark, d):
    state = F.when(F.col("tmean") < 38, "frozen_surface").when(F.col("tmean") <= 40, "freeze_transition").otherwise("liquid")
    return T.weather(spark, d).select("station", "day", scoring.frozen_suppression(state)["layers_reliable"].alias("reliable"))


@query("advisory_reasons", "SELECT event_id, 'base' || CASE WHEN event_id % 2 = 0 THEN ',frozen' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ',wide interval' ELSE '' END AS reasons FROM events")
def _(spark, d):
    k = F.col("event_id")
    return T.table(spark, d, "events").select("event_id", F.array_join(scoring.advisory_reasons(F.array(F.lit("base")), {"frozen": k % 2 == 0, "wide interval": k % 3 == 0}), ",").alias("reasons"))


@query("shadow_evidence", T.with_("observations") + """
SELECT observation_id AS run_id, cloud_fraction AS first, CASE WHEN observation_id % 3 = 0 THEN alignment_error END AS second, CASE WHEN observation_id % 3 = 0 THEN 2 ELSE 1 END AS components, cloud_fraction >= 0.7 AND observation_id % 4 <> 0 AS fired FROM observations""")
def _(spark, d):
    o = T.observations(spark, d).withColumnRenamed("observation_id", "run_id")
    runs = o.select("run_id", (F.col("run_id") % 4 == 0).alias("frozen"))
    out = scoring.shadow_evidence(runs, {"first": o.select("run_id", F.col("cloud_fraction").alias("score")), "second": o.where("run_id % 3 = 0").select("run_id", F.col("alignment_error").alias("score"))})
    return out.select("run_id", "first", "second", F.size("components").alias("components"), F.col("trigger").alias("fired"))


@query("latest_window_fallback", T.with_("weather") + """
, o AS (SELECT station * 100000 + (day - DATE '1970-01-01') AS event_id, station, day AS event_date, precip * 0.5::DOUBLE AS rain_24h, precip * 3 AS rain_7d FROM weather),
j AS (SELECT o.event_id, w.precip, w.tmean - 6.5 * (5010.0 - w.station_elev) / 1000 AS t, o.event_date - w.day AS ago FROM o JOIN weather w ON w.station = o.station AND o.event_date - w.day BETWEEN 0 AND 29),
f AS (SELECT event_id, sum(coalesce(precip, 0)) AS r30, sum(coalesce(precip, 0)) FILTER (ago < 7) AS r7, max(coalesce(precip, 0)) AS most, sum(greatest(0, t)) AS melt, count(t) AS n, 60 - count(precip) - count(t) AS nulls FROM j GROUP BY event_id)
SELECT event_id, round(CASE WHEN nulls <= 4 THEN r30 END, 6) AS rain_30d, round(CASE WHEN nulls <= 4 THEN r7 ELSE rain_7d END, 6) AS rain_7d, round(CASE WHEN nulls <= 4 THEN most ELSE rain_24h END, 6) AS rain_max,
  round(CASE WHEN nulls <= 4 THEN melt WHEN n >= 15 THEN round(melt, 2) END, 6) AS melt, CASE WHEN nulls <= 4 THEN 'full' WHEN n >= 15 THEN 'partial' ELSE 'none' END AS basis FROM o LEFT JOIN f USING (event_id)""")
def _(spark, d):
    w = T.weather(spark, d)
    o = w.selectExpr("station * 100000 + unix_date(day) AS event_id", "station", "day AS event_date", "5010.0D AS elev_m", "precip * 0.5D AS rain_24h", "precip * 3 AS rain_7d")
    return rounded(weather.latest_window_fallback(o, w), "rain_30d", "rain_7d", "rain_max", "melt", digits=6)


@query("scalar_functions", T.with_("lakes") + f"""
, {_CRC_TABLE}
SELECT lake_id, CASE lake_id % 4 WHEN 0 THEN 'invisible' WHEN 1 THEN 'monitorable' ELSE 'marginal' END AS visibility, round(ln(1 + area_m2), 9) AS log_area, round(ln(1 + greatest(0, elev_m - 4000)), 9) AS log_distance,
  'lake-' || lpad(({_crc("('L' || lake_id)")} % 10000)::VARCHAR, 4, '0') AS stable, round(111320.0 * cos(radians(lat)), 6) AS east FROM lakes, crc_table""")
def _(spark, d):
    k = F.col("lake_id") % 4
    logs = S.log_features(F.col("area_m2"), F.col("elev_m") - 4000, F.col("area_m2"))
    vis = S.visibility_class(F.when(k == 1, 0.6).when(k == 0, 0.1).otherwise(0.3), F.when(k == 0, -11.0).otherwise(-14.0))
    out = T.lakes(spark, d).select("lake_id", vis.alias("visibility"), logs["log_area"].alias("log_area"), logs["log_distance"].alias("log_distance"), S.stable_id(F.concat(F.lit("L"), F.col("lake_id").cast("string")), 10000, 4, "lake-").alias("stable"), S.metres_per_degree(F.col("lat"))["east"].alias("east"))
    return rounded(rounded(out, "log_area", "log_distance"), "east", digits=6)


@query("severity_stage", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END::DOUBLE AS stage FROM events".format(*S.WATER_STAGES.values()))
def _(spark, d):
    names = F.array(*map(F.lit, S.WATER_STAGES))
    return T.table(spark, d, "events").select("event_id", S.severity_stage(F.element_at(names, (F.col("event_id") % 4 + 1).cast("int"))).alias("stage"))


@query("channel_stack", T.with_("cells") + "SELECT r, c, a, b FROM cells WHERE (r + c) % 5 <> 0")
def _(spark, d):
    cells = T.cells(spark, d)
    bands = cells.selectExpr("r", "c", "'a' AS band", "a AS value").unionByName(cells.where("(r + c) % 5 <> 0").selectExpr("r", "c", "'b' AS band", "b AS value"))
    return matching.channel_stack(bands, ["a", "b"]).selectExpr("r", "c", "channels[0] AS a", "channels[1] AS b")


@query("drawdown_vs_truth", T.with_("surveys") + "SELECT lake_id AS id, round((volume_m3 - 1200000) / 1200000 * 100, 6) AS percent_error, volume_m3 BETWEEN 1000000 AND 1400000 AS in_range FROM surveys")
def _(spark, d):
    return rounded(matching.drawdown_vs_truth(T.surveys(spark, d).selectExpr("lake_id AS id", "volume_m3 AS volume"), 1e6, 1.4e6), "percent_error", digits=6)


@query("platt_calibration")
def _(spark, d):
    s = T.scores(spark, d)
    slope, offset = learning.platt_fit(s)
    return s.select("sample_id", F.round(S.platt(F.col("score"), slope, offset), 6).alias("platt"), F.round(S.interpolate(F.col("score"), learning.isotonic_fit(s)), 6).alias("isotonic"))


@query("filled_depressions")
def _(spark, d):
    return terrain.fill_depressions(T.cells(spark, d).select("r", "c", F.col("a").alias("z")))
