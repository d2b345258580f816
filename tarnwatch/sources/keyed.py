"""Rules over operational tables: keys, references, row rules, gates and tables that only grow."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """What holds for one table. The first column is the key; ``required`` ones are never null once defaults are filled in."""

    columns: str
    required: tuple[str, ...]
    defaults: Mapping[str, object] = field(default_factory=dict)
    references: Mapping[str, str] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    rules: tuple[str, ...] = ()
    #: (column, table it refers to, what must hold of that row, name of the rule)
    gates: tuple[tuple[str, str, str, str], ...] = ()
    append_only: bool = False

    @property
    def key(self) -> str:
        return self.columns.split()[0]


_SHARE = "{0} IS NULL OR {0} BETWEEN 0 AND 1"
#: The operational tables. Times are ISO texts.
TABLES = {
    "basins": Table("basin_id string, name string, boundary_geojson string, crs string, created_at string", ("name", "boundary_geojson"), {"crs": "EPSG:4326"}),
    "observations": Table(
        "observation_id string, basin_id string, acquired_at string, source string, raster_uri string, crs string, quality_score double, cloud_fraction double, optical_cloud_fraction double, alignment_ok int, usable int, "
        "confidence_adjustment double, water_area_km2 double, water_area_change_percent double, rainfall_24h_mm double, rainfall_7d_mm double, temp_mean_c double, temp_index double, mean_slope_degrees double, "
        "processing_version string, status string, created_at string",
        ("basin_id", "acquired_at", "source", "raster_uri", "processing_version"),
        {"crs": "EPSG:4326", "status": "ingested"},
        {"basin_id": "basins"},
        rules=(*(_SHARE.format(c) for c in ("quality_score", "cloud_fraction", "optical_cloud_fraction", "confidence_adjustment", "temp_index")), "status IN ('ingested', 'processed', 'failed')"),
    ),
    "runs": Table(
        "run_id string, observation_id string, processing_version string, change_mask_uri string, corridor_geojson string, change_stats_json string, started_at string, finished_at string",
        ("observation_id", "processing_version"),
        references={"observation_id": "observations"},
    ),
    "scores": Table(
        "score_id string, run_id string, hazard_score double, exposure_priority double, disease_risk double, confidence double, severity string, reasons_json string, method string, created_at string",
        ("run_id", "hazard_score", "exposure_priority", "confidence", "severity", "reasons_json"),
        references={"run_id": "runs"},
        rules=("severity IN ('informational', 'watch', 'elevated', 'critical')", "confidence BETWEEN 0 AND 1", "severity NOT IN ('elevated', 'critical') OR json_array_length(reasons_json) >= 3"),
    ),
    "assets": Table("asset_id string, basin_id string, asset_type string, name string, geometry_geojson string, population long, weight double", ("basin_id", "asset_type", "geometry_geojson"), {"weight": 1.0}, {"basin_id": "basins"}),
    "exposures": Table(
        "exposure_id string, run_id string, asset_id string, distance_m double, buffer_m double, inundated int, created_at string", ("run_id", "asset_id"), {"inundated": 0}, {"run_id": "runs", "asset_id": "assets"}, rules=("inundated IN (0, 1)",)
    ),
    "reviews": Table(
        "review_id string, score_id string, reviewer string, decision string, note string, decided_at string",
        ("score_id", "reviewer", "decision"),
        references={"score_id": "scores"},
        rules=("decision IN ('confirm', 'reject', 'postpone', 'escalate')",),
    ),
    "dispatches": Table(
        "dispatch_id string, review_id string, alert_id string, geofence_id string, payload string, payload_bytes int, channel string, recipient_group string, status string, sent_at string",
        ("review_id", "alert_id", "geofence_id", "payload", "payload_bytes", "channel", "recipient_group"),
        {"status": "sent"},
        {"review_id": "reviews"},
        rules=("payload_bytes <= 250",),
        gates=(("review_id", "reviews", "decision = 'confirm'", "review is not a confirmation"),),
    ),
    "audit_log": Table(
        "entry_id long, alert_id string, actor string, action string, detail_json string, created_at string, prev_hash string, event_hash string", ("actor", "action", "detail_json", "prev_hash", "event_hash"), append_only=True
    ),
    "acquisition_jobs": Table(
        "job_id string, source string, provider_product_id string, status string, download_url string, local_path string, acquired_at string, attempts int, last_error string, created_at string, updated_at string",
        ("source", "provider_product_id"),
        {"status": "pending", "attempts": 0},
        unique=(("source", "provider_product_id"),),
        rules=("status IN ('pending', 'downloading', 'verified', 'ready', 'failed', 'dead_letter')",),
    ),
}


def typed_rows(documents: DataFrame, table: str) -> DataFrame:
    """(json) records as rows of a table, with its defaults where a field is missing."""
    t = TABLES[table]
    rows = documents.select(F.from_json("json", t.columns).alias("r")).select("r.*")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in t.defaults.items()}) if t.defaults else rows


def _errors(rows: DataFrame, name: str, key: str, rule: str) -> DataFrame:
    return rows.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"))


def broken_rules(tables: Mapping[str, DataFrame]) -> DataFrame:
    """SRC-16: (table, key, rule) for each row and rule that it breaks, over the tables at hand.

    Row rules are one pass over a table. Keys that occur twice are named once;
    of rows that share a unique combination all but the one with the smallest
    key are named. References are checked on the distinct values referred to,
    before they meet the rows, so a value that very many rows hold is one row
    of the anti-join. References to tables not at hand are not checked.
    """
    found = []
    for name, rows in tables.items():
        t = TABLES[name]
        own = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in (t.key, *t.required)] + [F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(r)) for r in t.rules]
        found.append(rows.select(F.lit(name).alias("table"), F.col(t.key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*own))).alias("rule")))
        twice = rows.where(F.col(t.key).isNotNull()).groupBy(t.key).count().where("count > 1")
        found.append(_errors(twice, name, t.key, f"{t.key} is repeated"))
        for columns in t.unique:
            first = rows.groupBy(*columns).agg(F.min(t.key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
            later = rows.join(first, list(columns)).where(F.col(t.key) > F.col("_first"))
            found.append(_errors(later, name, t.key, f"({', '.join(columns)}) is not unique"))
        checks = [(c, other, None, f"{c} is not in {other}") for c, other in t.references.items()] + list(t.gates)
        for column, other, condition, rule in checks:
            if other not in tables:
                continue
            wanted = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_ref")).distinct()
            target = tables[other].select(F.col(TABLES[other].key).alias("_ref"), *([F.expr(condition).alias("_ok")] if condition else []))
            if condition:
                bad = wanted.join(target.groupBy("_ref").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_ok")), "_ref").where("NOT _ok").select("_ref")
            else:
                bad = wanted.join(target.distinct(), "_ref", "left_anti")
            found.append(_errors(rows.join(bad, F.col(column) == F.col("_ref"), "left_semi"), name, t.key, rule))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def forbidden_changes(before: DataFrame, after: DataFrame, table: str) -> DataFrame:
    """SRC-16: (key, change) for rows of an append-only table that a later version of it lacks (deleted) or holds otherwise (updated)."""
    t = TABLES[table]
    if not t.append_only:
        raise ValueError(f"rows of {table} may change")
    columns = [c.split()[0] for c in t.columns.split(", ")]
    print_ = lambda df, n: df.select(F.col(t.key).alias("_key"), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias(n))
    joined = print_(before, "_old").join(print_(after, "_new"), "_key", "left")
    changed = joined.where(F.col("_new").isNull() | (F.col("_new") != F.col("_old")))
    return changed.select(F.col("_key").cast("string").alias("key"), F.when(F.col("_new").isNull(), "deleted").otherwise("updated").alias("change"))
