"""Reviews, dispatches, jobs, audit chains and payloads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: Level of each severity in a payload.
LEVELS = {"informational": 1, "watch": 2, "elevated": 3, "critical": 4}
MOST_BYTES = 250


def latest(rows: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """The newest row of each key. An aggregate, so that copies of a key meet only after partial maxima."""
    by = F.struct(*newest)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*key, "_r.*")


def latest_review(reviews: DataFrame) -> DataFrame:
    """WN-01: the review that counts is the last by (decided_at, review_id)."""
    return latest(reviews, ["run_id"], ["decided_at", "review_id"]).withColumn("confirmed", F.col("decision") == "confirm")


def dispatch_gate(dispatches: DataFrame, reviews: DataFrame) -> DataFrame:
    """WN-02: (dispatch_id, run_id, payload) with a verdict: ok, or why it is rejected."""
    d = dispatches.join(latest_review(reviews).select("run_id", "decision"), "run_id", "left")
    verdict = F.when(F.col("decision").isNull(), "no review").when(F.col("decision") != "confirm", "not confirmed").when(F.octet_length("payload") > MOST_BYTES, "too large")
    return d.select("dispatch_id", "run_id", F.octet_length("payload").alias("bytes"), verdict.otherwise("ok").alias("verdict"))


def upsert_latest(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """WN-03: newer values win, created_at stays, attempts count up, a null path keeps the old one.

    Both have (key, status, path, seq, created_at).
    """
    every = stored.unionByName(incoming)
    return every.groupBy(*key).agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by("path", F.when(F.col("path").isNotNull(), F.col("seq"))).alias("path"),
        F.min("created_at").alias("created_at"),
        F.count("*").alias("attempts"),
    )


def job_listing(jobs: DataFrame, status: str) -> DataFrame:
    """WN-04"""
    return jobs.where(F.col("status") == status).orderBy(F.desc("created_at"), F.desc("job_id"))


def find_jobs(jobs: DataFrame, source, product) -> DataFrame:
    """WN-04: the job of a source and its product, if any."""
    return jobs.where((F.col("source") == source) & (F.col("product") == product))


def audit_query(audit: DataFrame, *, contains: str, limit: int) -> DataFrame:
    """WN-05: newest entries whose detail names something."""
    return audit.where(F.col("detail").contains(contains)).orderBy(F.desc("entry_id")).limit(limit)


def audit_lineage(audit: DataFrame, *, alert=None, run=None) -> DataFrame:
    """WN-05: all entries of an alert, or whose detail names a run in quotes, or both, in the order made."""
    found = audit if alert is None else audit.where(F.col("alert") == alert)
    found = found if run is None else found.where(F.coalesce(F.col("detail").contains(f'"{run}"'), F.lit(False)))
    return found.orderBy("entry_id")


def audit_recent(audit: DataFrame, *, action: str | None = None, limit: int = 100) -> DataFrame:
    """WN-05: the newest entries of an action, or of all."""
    return (audit if action is None else audit.where(F.col("action") == action)).orderBy(F.desc("entry_id")).limit(limit)


def _appender(key: str):
    """Rows come sorted by key and entry; all that is kept between batches is the key at hand and its last digest."""

    def run(batches):
        at_key, prev = None, GENESIS
        for pdf in batches:
            before, digests = [], []
            for k, at, detail in zip(pdf[key], pdf["created_at"], pdf["detail"], strict=True):
                if k != at_key:
                    at_key, prev = k, GENESIS
                before.append(prev)
                prev = hashlib.sha256(f"{prev}{at}{detail}".encode()).hexdigest()
                digests.append(prev)
            yield pdf.assign(prev_hash=before, event_hash=digests)

    return run


def build_chain(entries: DataFrame, key: str) -> DataFrame:
    """WN-07: (key, entry_id, created_at string, detail) chained by sha256, one chain for each key.

    Each digest needs the one before, so the entries of a key are one sequence;
    they stream through a task and are never held together.
    """
    rows = entries.select(key, "entry_id", "created_at", "detail")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", prev_hash string, event_hash string"
    return rows.repartition(key).sortWithinPartitions(key, "entry_id").mapInPandas(_appender(key), schema)


def verify_chain(chained: DataFrame, key: str) -> DataFrame:
    """WN-06: whether each chain holds, and its first broken entry."""
    own = F.sha2(F.concat("prev_hash", "created_at", "detail"), 256) == F.col("event_hash")
    before = F.coalesce(F.lag("event_hash").over(Window.partitionBy(key).orderBy("entry_id")), F.lit(GENESIS))
    marked = chained.withColumn("_ok", own & (F.col("prev_hash") == before))
    return marked.groupBy(key).agg(F.count("*").alias("entries"), F.bool_and("_ok").alias("valid"), F.min(F.when(~F.col("_ok"), F.col("entry_id"))).alias("first_break"))


#: What a payload asks for, and most routes in it.
ACTIONS = ("BOIL_WATER_NOW", "MONITOR")
MOST_ROUTES = 5


def payload_fields(exposures: DataFrame) -> DataFrame:
    """SC-16: what a run's payload says of its exposures (run_id, asset_id, line, asset_type, population, inundated): people, the first cut routes, the action."""
    cut = F.col("asset_type").isin("bridge", "road") & F.col("inundated")
    people = exposures.groupBy("run_id").agg(F.sum(F.coalesce("population", F.lit(0))).alias("population"), F.bool_or((F.col("asset_type") == "well") & F.col("inundated")).alias("_wells"))
    first = exposures.where(cut).withColumn("_k", F.row_number().over(Window.partitionBy("run_id").orderBy("line", "asset_id"))).where(F.col("_k") <= MOST_ROUTES)
    routes = first.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "asset_id"))), lambda x: x["asset_id"].cast("string")).alias("routes"))
    action = F.when(F.coalesce("_wells", F.lit(False)), ACTIONS[0]).otherwise(ACTIONS[1])
    return people.join(routes, "run_id", "left").select("run_id", "population", F.coalesce("routes", F.array().cast("array<string>")).alias("routes"), F.array(action).alias("flags"))


def alert_payload(runs: DataFrame) -> DataFrame:
    """SC-16: compact JSON in a fixed order, with its size and what is wrong with it.

    Needs run_id, geofence, hazard, severity, population, routes (array), flags
    (array); arrivals (map of sector to minutes) where there are any.
    """
    level = F.lit(None).cast("int")
    for k, v in LEVELS.items():
        level = F.when(F.col("severity") == k, v).otherwise(level)
    body = [
        F.concat(F.lit("alert-"), F.lpad((F.crc32(F.encode(F.col("run_id").cast("string"), "UTF-8")) % 10000).cast("string"), 4, "0")).alias("aid"),
        F.col("geofence").alias("sec"), F.col("hazard").alias("haz"), level.alias("lvl"), F.col("population").alias("exp_pop"), F.slice("routes", 1, MOST_ROUTES).alias("crit"), F.col("flags").alias("med_act"),
    ]
    if "arrivals" in runs.columns:
        known = F.transform_values(F.map_filter("arrivals", lambda k, v: v.isNotNull()), lambda k, v: F.rint(v).cast("int"))
        body.append(F.when(F.size(known) > 0, known).alias("t_arr"))  # left out of the text where null
    out = runs.select("run_id", F.to_json(F.struct(*body)).alias("payload"), level.alias("_level"))
    size = F.octet_length("payload")
    error = F.when(F.col("_level").isNull(), "unknown severity").when(size > MOST_BYTES, "too large")
    return out.select("run_id", "payload", size.alias("bytes"), error.alias("error"))


def decode_payload(payloads: DataFrame) -> DataFrame:
    """SC-16 reversed."""
    schema = "aid string, sec string, haz string, lvl int, exp_pop long, crit array<string>, med_act array<string>, t_arr map<string, int>"
    p = payloads.withColumn("_p", F.from_json("payload", schema))
    name = F.when(F.col("_p.lvl").isNotNull(), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("_p.lvl")))
    return p.select("run_id", F.col("_p.aid").alias("alert_id"), name.alias("severity"), F.col("_p.exp_pop").alias("population"), F.size("_p.crit").alias("routes"), F.col("_p.t_arr").alias("arrivals"))


def rank_sectors(sectors: DataFrame) -> DataFrame:
    """WN-08: sectors of each run by falling priority; equal ones keep their place."""
    order = Window.partitionBy("run_id").orderBy(F.desc("priority"), "place")
    return sectors.withColumn("rank", F.row_number().over(order)).drop("place")


def sector_summary(ranked: DataFrame) -> DataFrame:
    """WN-08: of each run the top sector, how many are cut off or at risk, the worst of these states, and all that as a sentence."""
    cut, risk = F.col("access_loss") >= 1.0, (F.col("access_loss") >= 0.6) & (F.col("access_loss") < 1.0)
    top = F.min_by(F.struct("sector", "priority"), "rank")
    by = ranked.groupBy("run_id").agg(F.count("*").alias("sectors"), F.count_if(cut).alias("cut"), F.count_if(risk).alias("at_risk"), top.alias("_t"))
    state = F.when(F.col("cut") > 0, "cut").when(F.col("at_risk") > 0, "at_risk").otherwise("accessible")
    found = by.select("run_id", "sectors", "cut", "at_risk", state.alias("state"), F.col("_t.sector").alias("top_sector"), F.col("_t.priority").alias("top_priority"))
    counts = F.when(F.col("cut") > 0, F.format_string("%d of %d sectors cut off", "cut", "sectors")).when(F.col("at_risk") > 0, F.format_string("%d of %d sectors at risk", "at_risk", "sectors"))
    first = F.format_string("; first %s (%.3f)", "top_sector", "top_priority")
    return found.withColumn("summary", F.concat(F.coalesce(counts, F.format_string("%d sectors accessible", "sectors")), first))


def run_view(runs: DataFrame, scores: DataFrame, reviews: DataFrame) -> DataFrame:
    """JN-12: runs with their score, last review and status."""
    v = runs.join(scores, "run_id", "left").join(latest_review(reviews).select("run_id", "decision", "review_id"), "run_id", "left")
    return v.withColumn("status", F.when(F.col("finished_at").isNull(), "running").otherwise("finished"))
