"""Registered queries over weather, exposures, reviews and audit entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions import scalars as S
from tarnwatch.operators import ledger, scoring, weather
from tarnwatch.plans import standins as T
from tarnwatch.scratch import Scratch

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("antecedent_rain_rows", T.with_("weather") + """
SELECT station, day, coalesce(precip, 0) AS rain_24h, round(sum(coalesce(precip, 0)) OVER (PARTITION BY station ORDER BY day ROWS 6 PRECEDING), 6) AS rain_7d FROM weather""")
def _(spark, d):
    return weather.antecedent_rain_rows(T.weather(spark, d)).withColumn("rain_7d", F.round("rain_7d", 6))


@query("antecedent_rain_days", T.with_("climate") + """
SELECT station, day, precip AS rain_24h, sum(precip) OVER w AS rain_7d, (7 - count(precip) OVER w)::INT AS missing, count(precip) OVER w = 7 AS complete
FROM climate WINDOW w AS (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return weather.antecedent_rain_days(T.climate(spark, d))


@query("thermal_state", T.with_("weather") + """
, t AS (SELECT station, day, (count(tmean) OVER w) / 7.0::DOUBLE AS coverage, avg(tmean) OVER w - 6.5 * (5010.0 - station_elev) / 1000 AS lake_temp
  FROM weather WINDOW w AS (PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
SELECT station, day, round(coverage, 6) AS coverage, round(lake_temp, 6) AS lake_temp, CASE WHEN coverage < 0.5 OR lake_temp IS NULL THEN 'unknown' WHEN lake_temp < -1.5 THEN 'frozen_surface'
  WHEN lake_temp <= 0.5 THEN 'freeze_transition' ELSE 'liquid' END AS state FROM t""")
def _(spark, d):
    return weather.thermal_state(T.weather(spark, d), 5010.0).withColumns({c: F.round(c, 6) for c in ("coverage", "lake_temp")})


@query("observation_weather", T.with_("climate", "observations") + """
, r AS (SELECT station, day, tmean, coalesce(precip, 0) AS rain_24h, sum(coalesce(precip, 0)) OVER (PARTITION BY station ORDER BY day ROWS 6 PRECEDING) AS rain_7d FROM climate)
SELECT observation_id, coalesce(rain_24h, 0) AS rain_24h, coalesce(rain_7d, 0) AS rain_7d, coalesce(tmean, 12.0) AS temp
FROM observations LEFT JOIN r ON r.station = basin_id % 2 AND acquired_at = day""")
def _(spark, d):
    obs = T.observations(spark, d).withColumn("station", F.col("basin_id") % 2)
    return weather.observation_weather(obs, T.climate(spark, d)).select("observation_id", "rain_24h", "rain_7d", "temp")


def _events(spark, d):
    return T.catalogue(spark, d).withColumns({"station": F.lit(0).cast("long"), "elev_m": 4000.0 + F.col("event_id") % 10 * 100})


_EVENTS_SQL = ", e AS (SELECT *, 0::BIGINT AS station, 4000.0::DOUBLE + event_id % 10 * 100 AS elev_m FROM catalogue)"
_FEATURES_SQL = _EVENTS_SQL + """
, f AS (SELECT event_id, sum(coalesce(precip, 0)) AS rain_30d, sum(CASE WHEN event_date - day < 7 THEN coalesce(precip, 0) ELSE 0 END) AS rain_7d, max(coalesce(precip, 0)) AS rain_max,
  count(*) FILTER (WHERE precip > 25) AS wet_days, sum(coalesce(precip, 0) * pow(0.9::DOUBLE, event_date - day)) AS decay_index,
  sum(greatest(0, tmean - 6.5 * (elev_m - station_elev) / 1000)) AS melt_degree_days,
  count(*) FILTER (WHERE event_date - day < 14 AND tmin - 6.5 * (elev_m - station_elev) / 1000 < 0 AND tmax - 6.5 * (elev_m - station_elev) / 1000 > 0) AS freeze_thaw,
  60 - count(precip) - count(tmean) AS nulls, max(elev_m) AS elev_m
  FROM e JOIN climate USING (station) WHERE event_date - day BETWEEN 0 AND 29 GROUP BY event_id)"""


@query("event_window_features", T.with_("climate", "catalogue") + _FEATURES_SQL + """
SELECT event_id, rain_30d, rain_7d, rain_max, wet_days, round(decay_index, 6) AS decay_index, round(melt_degree_days, 6) AS melt_degree_days, freeze_thaw, elev_m FROM f WHERE nulls <= 4""")
def _(spark, d):
    return weather.event_windows(_events(spark, d), T.climate(spark, d)).withColumns({c: F.round(c, 6) for c in ("decay_index", "melt_degree_days")})


@query("climatology_anomaly", T.with_("climate", "catalogue") + _EVENTS_SQL + """
, b AS (SELECT event_id, k, (event_date - k * 365)::DATE AS e FROM e, (SELECT unnest(range(0, 11))::INT AS k)),
s AS (SELECT event_id, k, sum(precip) AS rain FROM b JOIN climate ON day BETWEEN b.e - 29 AND b.e GROUP BY event_id, k HAVING count(precip) = 30),
a AS (SELECT event_id, max(rain) FILTER (WHERE k = 0) - avg(rain) FILTER (WHERE k > 0) AS anomaly FROM s GROUP BY event_id)
SELECT event_id, round(anomaly, 6) AS anomaly FROM e LEFT JOIN a USING (event_id)""")
def _(spark, d):
    return weather.climatology_anomaly(_events(spark, d), T.climate(spark, d)).withColumn("anomaly", F.round("anomaly", 6))


@query("trend_class", T.with_("observations") + """
, s AS (SELECT *, water_area_km2 < 0.95 * lag(water_area_km2) OVER (PARTITION BY basin_id ORDER BY acquired_at, observation_id) AS drops FROM observations),
b AS (SELECT basin_id, count(*) AS n, coalesce(arg_min(water_area_km2, (acquired_at, observation_id)) FILTER (WHERE water_area_km2 > 0), 1.0) AS first, arg_max(water_area_km2, (acquired_at, observation_id)) AS last, bool_or(coalesce(drops, false)) AS drops FROM s GROUP BY basin_id),
k AS (SELECT basin_id, n, (last - first) / first * 100 AS percent, CASE WHEN n < 2 OR drops THEN 'uncertain' WHEN (last - first) / first * 100 >= 20 THEN 'rapidly' WHEN (last - first) / first * 100 >= 5 THEN 'slowly' ELSE 'stable' END AS trend FROM b)
SELECT basin_id, n, round(percent, 6) AS percent, trend, CASE trend WHEN 'rapidly' THEN floor(least(0.9::DOUBLE, 0.5::DOUBLE + percent / 100) * 1000.0::DOUBLE + 0.500000001::DOUBLE) / 1000.0::DOUBLE WHEN 'slowly' THEN 0.5 WHEN 'stable' THEN 0.9 ELSE 0.3 END AS confidence FROM k""")
def _(spark, d):
    o = T.observations(spark, d).withColumnRenamed("water_area_km2", "area")
    return weather.trend_class(o).withColumn("percent", F.round("percent", 6))


@query("trend_of_few", T.with_("observations").replace("o_custkey % 20 AS basin_id", "o_custkey AS basin_id") + ORACLE_SQL["trend_class"].removeprefix(T.with_("observations")))
def _(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("basin_id"), F.to_date("o_orderdate").alias("acquired_at"), (F.col("o_totalprice") / 100000.0).alias("area"), F.col("o_orderkey").alias("observation_id"))
    return weather.trend_class(o).withColumn("percent", F.round("percent", 6))


@query("event_features", ORACLE_SQL["event_window_features"].replace("SELECT event_id, rain_30d", """, anomalies AS (""" + ORACLE_SQL["climatology_anomaly"] + """)
SELECT event_id, anomaly, area_m2, rain_30d""").replace("FROM f WHERE", "FROM f JOIN anomalies USING (event_id) JOIN (SELECT event_id, area_m2 FROM catalogue) USING (event_id) WHERE"))
def _(spark, d):
    e = _events(spark, d)
    out = weather.event_features(e.select("event_id", "station", "event_date", "elev_m"), T.climate(spark, d), e.select("event_id", "area_m2"))
    return out.withColumns({c: F.round(c, 6) for c in ("decay_index", "melt_degree_days", "anomaly")})


@query("month_share", T.with_("catalogue") + """
, m AS (SELECT month(event_date) AS month, count(*) AS events FROM catalogue GROUP BY 1)
SELECT month::INT AS month, events, (sum(CASE WHEN month IN (6,7,8,9) THEN events ELSE 0 END) OVER ())::DOUBLE / sum(events) OVER () AS season_share FROM m""")
def _(spark, d):
    return weather.month_share(T.catalogue(spark, d))


@query("quality_gate", T.with_("observations") + """
, q AS (SELECT *, CASE WHEN contains(lower(source), 'sentinel-1') OR contains(lower(source), 'sar') THEN 0.0 ELSE cloud_fraction END AS cloud FROM observations)
SELECT observation_id, cloud, cloud < 0.2 AS usable, alignment_error < 1 AS alignment_ok, round((1 - cloud) * CASE WHEN contains(lower(source), 'nrt') THEN 1.0 ELSE 0.9 END, 6) AS confidence,
  round((1 - cloud) * 0.6 + CASE WHEN alignment_error < 1 THEN 1.0 ELSE 0.5 END * 0.4, 6) AS score, CASE WHEN cloud >= 0.2 THEN 'sar' ELSE 'optical' END AS path FROM q""")
def _(spark, d):
    q = T.observations(spark, d).withColumn("q", S.quality_gate(F.col("cloud_fraction"), F.col("alignment_error"), F.col("source")))
    q = q.withColumn("route", S.route_sensor(F.col("q.cloud"), F.col("q.usable")))
    return q.select("observation_id", "q.cloud", "q.usable", "q.alignment_ok", F.round("q.confidence", 6).alias("confidence"), F.round("q.score", 6).alias("score"), "route.path")


@query("scope_flag", T.with_("observations") + "SELECT observation_id, month(acquired_at) IN (6,7,8,9) AS in_scope FROM observations")
def _(spark, d):
    return T.observations(spark, d).select("observation_id", S.in_scope(F.col("acquired_at")).alias("in_scope"))


@query("temp_indices", T.with_("weather") + """
SELECT station, day, round(CASE WHEN tmean < 5 THEN 0.3 WHEN tmean < 15 THEN 0.4 + (tmean - 5) * 0.02 WHEN tmean < 25 THEN 0.6 + (tmean - 15) * 0.02 ELSE least(1.0, 0.8 + (tmean - 25) * 0.01) END, 6) AS piecewise,
  round(greatest(0, least(1, tmean / 20)), 6) AS linear FROM weather""")
def _(spark, d):
    t = F.col("tmean")
    return T.weather(spark, d).select("station", "day", F.round(S.temp_index_piecewise(t), 6).alias("piecewise"), F.round(S.temp_index_linear(t), 6).alias("linear"))


_ROLLUP_SQL = """
, roll AS (SELECT run_id, sum(CASE WHEN asset_type = 'settlement' THEN population ELSE 0 END)::BIGINT AS population, count(*) FILTER (WHERE asset_type IN ('village','settlement')) AS settlements,
  count(*) FILTER (WHERE asset_type = 'bridge') AS bridges, count(*) FILTER (WHERE asset_type = 'well') AS wells, count(*) FILTER (WHERE asset_type = 'well' AND inundated) AS inundated_wells,
  max(CASE WHEN asset_type IN ('bridge','road') AND inundated THEN 1.0 WHEN asset_type IN ('bridge','road') AND distance_m <= buffer_m THEN 0.6 ELSE 0.3 END)::DOUBLE AS access_loss FROM exposures GROUP BY run_id)"""


@query("exposure_rollup", T.with_("exposures") + _ROLLUP_SQL + "SELECT * FROM roll")
def _(spark, d):
    return scoring.exposure_rollup(T.exposures(spark, d))


def scored_runs(spark, d):
    """SC-18: every observation with its weather, exposures and scores, as one lazy job."""
    obs = T.observations(spark, d).withColumn("station", F.lit(0).cast("long"))
    rolled = scoring.exposure_rollup(T.exposures(spark, d))
    runs = weather.observation_weather(obs, T.climate(spark, d)).join(rolled, F.col("observation_id") == F.col("run_id"))
    runs = runs.withColumns(
        {
            "trend": F.element_at(F.array(*map(F.lit, ("stable", "slowly", "rapidly", "uncertain"))), (F.col("run_id") % 4 + 1).cast("int")),
            "expansion": (F.col("run_id") % 45).cast("double"),
            "slope": (F.col("run_id") % 50).cast("double"),
            "drainage": F.col("run_id") % 2 == 0,
            "density": F.col("population") / 10,
            "temp_index": S.temp_index_piecewise(F.col("temp")),
        }
    )
    return scoring.fuse(runs)


_SCORED_SQL = T.with_("climate", "observations", "exposures") + _ROLLUP_SQL + """
, r AS (SELECT day, tmean, precip AS rain_24h, sum(precip) OVER (ORDER BY day ROWS 6 PRECEDING) AS rain_7d FROM climate),
x AS (SELECT run_id, population, settlements, bridges, wells, inundated_wells, coalesce(rain_24h, 0) AS rain_24h, coalesce(rain_7d, 0) AS rain_7d, coalesce(tmean, 12.0) AS temp, (run_id % 45)::DOUBLE AS expansion,
  (run_id % 50)::DOUBLE AS slope, CASE run_id % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.4 WHEN 2 THEN 0.9 ELSE 0.3 END AS tv, CASE WHEN run_id % 2 = 0 THEN 1.0 ELSE 0.2 END AS dv, settlements + bridges + wells AS assets
  FROM observations LEFT JOIN r ON acquired_at = day JOIN roll ON observation_id = run_id),
y AS (SELECT *, CASE WHEN temp < 5 THEN 0.3 WHEN temp < 15 THEN 0.4 + (temp - 5) * 0.02 WHEN temp < 25 THEN 0.6 + (temp - 15) * 0.02 ELSE least(1.0, 0.8 + (temp - 25) * 0.01) END AS ti,
  floor((0.30 * tv + 0.25 * least(1.0, expansion / 30) + 0.20 * greatest(least(1.0, rain_24h / 100), least(1.0, rain_7d / 250) * 0.8) + 0.15 * least(1.0, slope / 45) + 0.10 * dv) * 1000.0::DOUBLE + 0.500000001::DOUBLE) / 1000.0::DOUBLE AS hazard FROM x),
z AS (SELECT *, CASE WHEN expansion >= 40 THEN 'critical' WHEN hazard >= 0.7 AND (assets > 0 OR population > 500) THEN 'critical' WHEN hazard >= 0.5 THEN 'elevated' WHEN hazard >= 0.3 THEN 'watch' ELSE 'informational' END AS severity FROM y)
SELECT run_id, hazard, floor((hazard * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, population / 2000.0::DOUBLE)) * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, assets / 10.0::DOUBLE))) * 1000.0::DOUBLE + 0.500000001::DOUBLE) / 1000.0::DOUBLE AS exposure,
  floor((least(1.0::DOUBLE, inundated_wells / 5.0::DOUBLE) * (0.4::DOUBLE + 0.6::DOUBLE * least(1.0::DOUBLE, population / 10.0::DOUBLE / 500)) * ti) * 1000.0::DOUBLE + 0.500000001::DOUBLE) / 1000.0::DOUBLE AS disease, severity, population * 28 AS chlorine_tablets, inundated_wells > 0 AS boil_water,
  CASE WHEN severity IN ('elevated', 'critical') THEN 8 ELSE 5 END AS reasons FROM z"""


@query("run_batch", _SCORED_SQL)
def _(spark, d):
    return scored_runs(spark, d).select(
        "run_id", "hazard", "exposure", "disease", "severity", "chlorine_tablets", "boil_water", F.size("reasons").alias("reasons")
    )


_SERVED_SQL = """
, wv AS (SELECT w.run_id, w.asset_id AS well, w.line, max(w.population) AS own, count(v.line) AS villages, arg_min(v.population, (abs(w.distance_m - coalesce(nullif(v.distance_m, 0), 9999)), v.line, v.asset_id)) AS nearest
  FROM exposures w LEFT JOIN exposures v ON v.run_id = w.run_id AND v.asset_type = 'village' WHERE w.asset_type = 'well' GROUP BY ALL),
served AS (SELECT run_id, well, line, CASE WHEN villages = 0 THEN 0 WHEN own > 0 THEN own ELSE nearest END AS served FROM wv)"""


@query("served_population", T.with_("exposures").replace("(l_quantity * 10)", "(CASE WHEN l_quantity > 25 THEN 0 ELSE l_quantity * 10 END)") + _SERVED_SQL + "SELECT * FROM served")
def _(spark, d):
    e = T.exposures(spark, d)
    return scoring.served_population(e.withColumn("population", F.when(F.col("population") > 250, 0).otherwise(F.col("population"))))


@query("rank_sectors", T.with_("exposures") + _ROLLUP_SQL + _SERVED_SQL + """
, sec AS (SELECT run_id, concat_ws('-', 'village', asset_id, line) AS sector, 'village' AS kind, population, 1.0 AS u, (0, line, asset_id) AS place FROM exposures WHERE asset_type = 'village'
  UNION ALL SELECT run_id, 'water-points', 'well', greatest(p, s), 0.7, (1, 0, 0) FROM (SELECT run_id, sum(population)::BIGINT AS p FROM exposures WHERE asset_type = 'well' GROUP BY 1) JOIN (SELECT run_id, sum(served)::BIGINT AS s FROM served GROUP BY 1) USING (run_id)
  UNION ALL SELECT run_id, 'access-routes', 'bridge', sum(CASE WHEN asset_type = 'village' THEN population ELSE 0 END)::BIGINT, 0.5, (2, 0, 0) FROM exposures GROUP BY run_id HAVING count(*) FILTER (WHERE asset_type IN ('bridge','road')) > 0),
p AS (SELECT run_id, sector, kind, sec.population, access_loss, floor((least(1.0::DOUBLE, sec.population / 2000.0::DOUBLE) * access_loss * u::DOUBLE) * 1000.0::DOUBLE + 0.500000001::DOUBLE) / 1000.0::DOUBLE AS priority, place FROM sec JOIN roll USING (run_id))
SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, place)::INT AS rank FROM p""")
def _(spark, d):
    return ledger.rank_sectors(scoring.rescue_sectors(T.exposures(spark, d)))


@query("sector_summary", f"""
WITH ranked AS ({ORACLE_SQL["rank_sectors"]}), n AS (SELECT run_id, count(*) AS sectors, count(*) FILTER (WHERE access_loss >= 1) AS cut, count(*) FILTER (WHERE access_loss >= 0.6 AND access_loss < 1) AS at_risk FROM ranked GROUP BY run_id)
SELECT n.*, CASE WHEN cut > 0 THEN 'cut' WHEN at_risk > 0 THEN 'at_risk' ELSE 'accessible' END AS state, sector AS top_sector, priority AS top_priority,
  CASE WHEN cut > 0 THEN printf('%d of %d sectors cut off', cut, sectors) WHEN at_risk > 0 THEN printf('%d of %d sectors at risk', at_risk, sectors) ELSE printf('%d sectors accessible', sectors) END || printf('; first %s (%.3f)', sector, priority) AS summary FROM n JOIN ranked USING (run_id) WHERE rank = 1""")
def _(spark, d):
    return ledger.sector_summary(ledger.rank_sectors(scoring.rescue_sectors(T.exposures(spark, d))))


@query("personnel_registry", T.with_("exposures") + """
, s AS (SELECT run_id, count(*) FILTER (WHERE asset_type IN ('bridge','road') AND inundated) > 0 AS isolated FROM exposures GROUP BY run_id),
p AS (SELECT run_id, population, floor(population * CASE WHEN isolated THEN 0.935::DOUBLE ELSE 0.956::DOUBLE END)::BIGINT AS accounted, greatest(1, floor(population * 0.0113::DOUBLE))::BIGINT AS medical FROM exposures JOIN s USING (run_id) WHERE asset_type IN ('village','settlement') AND population > 0)
SELECT run_id, sum(population)::BIGINT AS population, sum(accounted)::BIGINT AS accounted, sum(population - accounted)::BIGINT AS unaccounted, sum(medical)::BIGINT AS medical FROM p GROUP BY ROLLUP (run_id)""")
def _(spark, d):
    return scoring.personnel_totals(scoring.personnel(T.exposures(spark, d)))


@query("latest_review", T.with_("reviews") + """
, l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY decided_at DESC, review_id DESC) AS k FROM reviews) SELECT run_id, review_id, decision, decided_at, decision = 'confirm' AS confirmed FROM l WHERE k = 1""")
def _(spark, d):
    return ledger.latest_review(T.reviews(spark, d))


@query("dispatch_gate", T.with_("reviews", "observations") + """
, l AS (SELECT run_id, arg_max(decision, (decided_at, review_id)) AS decision FROM reviews GROUP BY run_id),
p AS (SELECT observation_id AS dispatch_id, observation_id % 2500 AS run_id, repeat('x', (observation_id % 300)::INT) AS payload FROM observations)
SELECT dispatch_id, run_id, strlen(payload)::INT AS bytes, CASE WHEN decision IS NULL THEN 'no review' WHEN decision <> 'confirm' THEN 'not confirmed' WHEN strlen(payload) > 250 THEN 'too large' ELSE 'ok' END AS verdict FROM p LEFT JOIN l USING (run_id)""")
def _(spark, d):
    key = F.col("observation_id")
    p = T.observations(spark, d).select(key.alias("dispatch_id"), (key % 2500).alias("run_id"), F.expr("repeat('x', cast(observation_id % 300 AS INT))").alias("payload"))
    return ledger.dispatch_gate(p, T.reviews(spark, d))


_JOBS = "SELECT user_id % 50 AS source, user_id AS product, event_type AS status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'p' || event_id END AS path, event_id AS seq, ts AS created_at FROM events"


def _jobs(spark, d):
    e = T.table(spark, d, "events")
    path = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("p"), F.col("event_id").cast("string")))
    return e.select((F.col("user_id") % 50).alias("source"), F.col("user_id").alias("product"), F.col("event_type").alias("status"), path.alias("path"), F.col("event_id").alias("seq"), F.col("ts").alias("created_at"))


@query("upsert_latest", f"WITH j AS ({_JOBS}) SELECT source, product, arg_max(status, seq) AS status, arg_max(path, seq) FILTER (WHERE path IS NOT NULL) AS path, min(created_at) AS created_at, count(*) AS attempts FROM j GROUP BY source, product")
def _(spark, d):
    j = _jobs(spark, d)
    return ledger.upsert_latest(j.where("seq % 2 = 0"), j.where("seq % 2 = 1"), ["source", "product"])


@query("job_listing", f"WITH j AS ({_JOBS}) SELECT seq AS job_id, source, created_at FROM j WHERE status = 'error'")
def _(spark, d):
    return ledger.job_listing(_jobs(spark, d).withColumnRenamed("seq", "job_id"), "error").select("job_id", "source", "created_at")


@query("audit_query", "SELECT event_id AS entry_id, props AS detail FROM events WHERE contains(props, '\"k\": 7') ORDER BY event_id DESC LIMIT 100")
def _(spark, d):
    return ledger.audit_query(T.table(spark, d, "events").select(F.col("event_id").alias("entry_id"), F.col("props").alias("detail")), contains='"k": 7', limit=100)


@query("find_jobs", f"WITH j AS ({_JOBS}) SELECT seq AS job_id, source, product, status, path FROM j WHERE source = 7 AND product = 7")
def _(spark, d):
    return ledger.find_jobs(_jobs(spark, d).withColumnRenamed("seq", "job_id"), 7, 7).select("job_id", "source", "product", "status", "path")


_AUDIT = """SELECT event_id AS entry_id, user_id AS alert, event_type AS action, '{"run": "' || (event_id % 40) || '"}' AS detail FROM events"""


def _audit(spark, d):
    e = T.table(spark, d, "events")
    detail = F.concat(F.lit('{"run": "'), (F.col("event_id") % 40).cast("string"), F.lit('"}'))
    return e.select(F.col("event_id").alias("entry_id"), F.col("user_id").alias("alert"), F.col("event_type").alias("action"), detail.alias("detail"))


@query("audit_by_alert", f"SELECT * FROM ({_AUDIT}) WHERE alert = 7 ORDER BY entry_id")
def _(spark, d):
    return ledger.audit_lineage(_audit(spark, d), alert=7)


@query("audit_by_run", f"""SELECT * FROM ({_AUDIT}) WHERE contains(detail, '"4"') ORDER BY entry_id""")
def _(spark, d):
    return ledger.audit_lineage(_audit(spark, d), run="4")


@query("audit_by_action", f"SELECT * FROM ({_AUDIT}) WHERE action = 'purchase' ORDER BY entry_id DESC LIMIT 100")
def _(spark, d):
    return ledger.audit_recent(_audit(spark, d), action="purchase")


def _entries(spark, d):
    return T.table(spark, d, "events").select(F.col("user_id").alias("alert"), F.col("event_id").alias("entry_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), F.col("props").alias("detail"))


@query("hash_chain_verify", """
WITH RECURSIVE e AS (SELECT user_id AS alert, event_id AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at, props AS detail FROM events),
c AS (SELECT alert, n, entry_id, sha256(repeat('0', 64) || created_at || detail) AS h FROM e WHERE n = 1 UNION ALL SELECT e.alert, e.n, e.entry_id, sha256(c.h || e.created_at || e.detail) FROM c JOIN e ON e.alert = c.alert AND e.n = c.n + 1),
t AS (SELECT alert, n, entry_id, lag(h, 1, repeat('0', 64)) OVER w AS prev, h AS head, CASE WHEN entry_id % 89 = 0 THEN sha256(h) ELSE h END AS h FROM c WINDOW w AS (PARTITION BY alert ORDER BY n)),
k AS (SELECT t.*, lag(t.h, 1, repeat('0', 64)) OVER (PARTITION BY alert ORDER BY n) = prev AND sha256(prev || created_at || detail || CASE WHEN entry_id % 97 = 0 THEN '!' ELSE '' END) = t.h AS good FROM t JOIN e USING (alert, n, entry_id))
SELECT alert, count(*) AS entries, bool_and(good) AS valid, min(entry_id) FILTER (WHERE NOT good) AS first_break, max_by(head, n) AS head FROM k GROUP BY alert""")
def _(spark, d):
    """Details and digests of some entries are changed after the chain was built."""
    chained = Scratch(spark, "chain").cut(ledger.build_chain(_entries(spark, d), "alert"), "chained")
    head = chained.groupBy("alert").agg(F.max_by("event_hash", "entry_id").alias("head"))
    changed = chained.withColumns(
        {
            "detail": F.when(F.col("entry_id") % 97 == 0, F.concat("detail", F.lit("!"))).otherwise(F.col("detail")),
            "event_hash": F.when(F.col("entry_id") % 89 == 0, F.sha2("event_hash", 256)).otherwise(F.col("event_hash")),
        }
    )
    return ledger.verify_chain(changed, "alert").join(head, "alert")


@query("alert_payload")
def _(spark, d):
    runs = scored_runs(spark, d).select(
        "run_id", F.concat(F.lit("basin-"), F.col("basin_id").cast("string")).alias("geofence"), F.lit("glof").alias("hazard"), "severity", "population",
        F.transform(F.sequence(F.lit(0), F.col("bridges").cast("int")), lambda i: F.concat(F.lit("route-"), i.cast("string"))).alias("routes"), F.when(F.col("boil_water"), F.array(F.lit("boil"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )
    return ledger.alert_payload(runs)


@query("payload_fields", T.with_("exposures") + """
, k AS (SELECT run_id, asset_id, row_number() OVER (PARTITION BY run_id ORDER BY line, asset_id) AS k FROM exposures WHERE asset_type IN ('bridge', 'road') AND inundated),
t AS (SELECT run_id, string_agg(asset_id, ',' ORDER BY k) AS routes FROM k WHERE k <= 5 GROUP BY run_id)
SELECT run_id, sum(population)::BIGINT AS population, coalesce(any_value(routes), '') AS routes, CASE WHEN bool_or(asset_type = 'well' AND inundated) THEN 'BOIL_WATER_NOW' ELSE 'MONITOR' END AS flags FROM exposures LEFT JOIN t USING (run_id) GROUP BY run_id""")
def _(spark, d):
    return ledger.payload_fields(T.exposures(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("routes", "flags")})


@query("dispatch_payloads", T.with_("exposures") + f"""
, fields AS ({ORACLE_SQL["payload_fields"]}), p AS (SELECT *, CASE run_id % 5 WHEN 0 THEN 'informational' WHEN 1 THEN 'watch' WHEN 2 THEN 'elevated' WHEN 3 THEN 'critical' ELSE 'other' END AS severity FROM fields),
j AS (SELECT run_id, '"sec":"B","haz":"flood",' || CASE WHEN run_id % 5 < 4 THEN '"lvl":' || (run_id % 5 + 1) || ',' ELSE '' END || '"exp_pop":' || population || ',"crit":[' || CASE WHEN routes = '' THEN '' ELSE '"' || replace(routes, ',', '","') || '"' END || '],"med_act":["' || flags || '"]' ||
  CASE WHEN run_id % 3 = 0 THEN ',"t_arr":{{"sec_a":' || (population // 7) || '}}' ELSE '' END || '}}' AS tail, severity FROM p)
SELECT run_id, tail, (strlen(tail) + 20)::INT AS bytes, CASE WHEN severity = 'other' THEN 'unknown severity' WHEN strlen(tail) + 20 > 250 THEN 'too large' END AS error FROM j""")
def _(spark, d):
    """The payload less its id, which is a digest of the run's."""
    kinds = F.array(*map(F.lit, ("informational", "watch", "elevated", "critical", "other")))
    runs = ledger.payload_fields(T.exposures(spark, d)).withColumns(
        {
            "severity": F.element_at(kinds, (F.col("run_id") % 5 + 1).cast("int")), "geofence": F.lit("B"), "hazard": F.lit("flood"),
            "arrivals": F.create_map(F.lit("sec_a"), F.when(F.col("run_id") % 3 == 0, F.floor(F.col("population") / 7) + 0.25), F.lit("sec_b"), F.lit(None).cast("double")),
        }
    )
    return ledger.alert_payload(runs).select("run_id", F.substring("payload", 21, 1000).alias("tail"), "bytes", "error")


@query("pre_breach_warning", T.with_("scores") + "SELECT sample_id, coalesce(block > 1 AND score >= 0.65, false) AS warn, round(greatest(0, score - 0.2), 6) AS low, round(least(1, score + 0.2), 6) AS high FROM scores")
def _(spark, d):
    s = T.scores(spark, d).withColumn("i", scoring.interval(F.col("score"), 0.2))
    return s.select("sample_id", scoring.pre_breach_warning(F.col("block") - 1, F.col("score")).alias("warn"), F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


@query("top_reasons", T.with_("observations") + """
, c AS (SELECT observation_id, cloud_fraction, unnest([{'n': 'cloud', 'v': cloud_fraction - 0.5}, {'n': 'shift', 'v': alignment_error - 0.7}, {'n': 'area', 'v': 1 - floor(water_area_km2 * 1000) / 1000}, {'n': 'fixed', 'v': 0.3}]) AS x FROM observations),
k AS (SELECT observation_id, cloud_fraction, x.n AS n, x.v AS v, row_number() OVER (PARTITION BY observation_id ORDER BY -abs(x.v), x.n) AS k FROM c)
SELECT observation_id, CASE WHEN observation_id % 5 = 0 THEN printf('cloud %.3f,shift %.3f', cloud_fraction, alignment_error) ELSE string_agg(printf('%s %+.3f', n, v), ',' ORDER BY k) END
  || printf(',probability %.3f,interval %.3f wide', cloud_fraction, alignment_error / 2) || CASE WHEN alignment_error / 2 > 0.35 THEN ', to be inspected' ELSE '' END AS reasons
FROM k JOIN (SELECT observation_id, alignment_error FROM observations) USING (observation_id) WHERE k <= 3 GROUP BY observation_id, cloud_fraction, alignment_error""")
def _(spark, d):
    area = 1 - F.floor(F.col("water_area_km2") * 1000) / 1000
    pairs = {"cloud": F.col("cloud_fraction") - 0.5, "shift": F.col("alignment_error") - 0.7, "area": area, "fixed": F.lit(0.3)}
    named = lambda pairs: F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs.items()])
    known = F.when(F.col("observation_id") % 5 != 0, named(pairs))
    found = scoring.top_reasons(known, p=F.col("cloud_fraction"), width=F.col("alignment_error") / 2, raw=named({"cloud": F.col("cloud_fraction"), "shift": F.col("alignment_error")}))
    return T.observations(spark, d).select("observation_id", F.array_join(found, ",").alias("reasons"))


@query("run_view", T.with_("reviews", "observations") + """
, l AS (SELECT run_id, arg_max(decision, (decided_at, review_id)) AS decision, arg_max(review_id, (decided_at, review_id)) AS review_id FROM reviews GROUP BY run_id)
SELECT observation_id AS run_id, CASE WHEN observation_id % 4 = 0 THEN NULL ELSE acquired_at END AS finished_at, CASE WHEN observation_id % 2 = 0 THEN cloud_fraction END AS score, decision, review_id, CASE WHEN observation_id % 4 = 0 THEN 'running' ELSE 'finished' END AS status
FROM observations LEFT JOIN l ON l.run_id = observation_id""")
def _(spark, d):
    o = T.observations(spark, d)
    runs = o.select(F.col("observation_id").alias("run_id"), F.when(F.col("observation_id") % 4 != 0, F.col("acquired_at")).alias("finished_at"))
    return ledger.run_view(runs, o.where("observation_id % 2 = 0").select(F.col("observation_id").alias("run_id"), F.col("cloud_fraction").alias("score")), T.reviews(spark, d))
