"""Typed tables of operations, surveys and chips, and the records of where files came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.projection import degrees_from_utm
from tarnwatch.sources.keyed import TABLES, typed_rows


def operational_rows(documents: DataFrame, table: str) -> DataFrame:
    """SRC-16: (json) records as rows of a table, each with the list of its own rules that it breaks (empty for a good row)."""
    t = TABLES[table]
    broken = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in (t.key, *t.required)] + [F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(r)) for r in t.rules]
    return typed_rows(documents, table).withColumn("broken", F.array_compact(F.array(*broken)))


#: West, east, south, north of the surveys' area.
SURVEY_BOX = (80.0, 105.0, 25.0, 36.0)


def survey_points(rows: DataFrame) -> DataFrame:
    """SRC-09: (file, fields map<string, string>) of depth surveys whose headers vary -> lake, survey date, lat, lon, depth.

    A header counts by what it contains (lat, lon, depth). Rows without depth,
    at zero coordinates or outside the area go. Lake and date come from the
    file's name, as in ``Lake-Name_20200131.csv``.
    """
    named = lambda part: F.element_at(F.map_values(F.map_filter("fields", lambda k, _: F.lower(k).contains(part))), 1).try_cast("double")
    base = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    # element_at of an empty array is null only where it is tried
    out = rows.where(F.exists(F.map_keys("fields"), lambda k: F.lower(k).contains("lat")) & F.exists(F.map_keys("fields"), lambda k: F.lower(k).contains("lon")) & F.exists(F.map_keys("fields"), lambda k: F.lower(k).contains("depth")))
    out = out.select(F.regexp_extract(base, r"^(.*?)_?(\d{8})?$", 1).alias("lake"), F.try_to_date(F.regexp_extract(base, r"(\d{8})$", 1), "yyyyMMdd").alias("surveyed"), named("lat").alias("lat"), named("lon").alias("lon"), named("depth").alias("depth"))
    west, east, south, north = SURVEY_BOX
    return out.where((F.col("depth") > 0) & (F.col("lat") != 0) & (F.col("lon") != 0) & F.col("lon").between(west, east) & F.col("lat").between(south, north))


def projected_survey_points(rows: DataFrame, zone: int = 45) -> DataFrame:
    """SRC-09: (lake, surveyed, depth, lat, lon, east, north) soundings as places in degrees; metres of a UTM zone where degrees are missing, and only depths above 0."""
    lat, lon = degrees_from_utm(F.col("east"), F.col("north"), zone)
    depth = F.col("depth").try_cast("double")
    placed = rows.select("lake", "surveyed", depth.alias("depth"), F.coalesce("lat", lat).alias("lat"), F.coalesce("lon", lon).alias("lon"))
    return placed.where((F.col("depth") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def survey_records(points: DataFrame) -> DataFrame:
    """SRC-09: count, depths and bounds of each lake's survey."""
    return points.groupBy("lake", "surveyed").agg(
        F.count("*").alias("points"), F.max("depth").alias("deepest"), F.avg("depth").alias("mean_depth"), *[f(x).alias(f"{n}_{x}") for x in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    )


def published_lakes(rows: DataFrame) -> DataFrame:
    """SRC-10: (lake_type, name, area, volume, year text) -> numbers, and the first year that the text names; what has no volume goes."""
    year = F.regexp_extract("year", r"(\d{4})", 1).try_cast("int")
    out = rows.select("lake_type", F.trim("name").alias("name"), F.col("area").try_cast("double").alias("area_km2"), F.col("volume").try_cast("double").alias("volume_m3"), year.alias("year"))
    return out.where(F.col("volume_m3") > 0)


def photon_tracks(points: DataFrame) -> DataFrame:
    """SRC-11: one record for each track of (track, lat, lon, depth); only finite places and depths above 0 count."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = points.where(finite("lat") & finite("lon") & (F.col("depth") > 0) & finite("depth"))
    return kept.groupBy("track").agg(F.count("*").alias("points"), F.max("depth").alias("deepest"), F.avg("depth").alias("mean_depth"), *[f(x).alias(f"{n}_{x}") for x in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])


def chip_split_rows(lines: DataFrame) -> DataFrame:
    """SRC-12: (file, line) of headerless split files ``image,label[,split]`` -> rows; without a third field the file's name tells the split."""
    parts = F.split("line", ",")
    own = F.trim(F.get(parts, 2))
    named = F.regexp_extract("file", r"(train|valid|test)[^/]*$", 1)
    out = lines.select(F.trim(F.get(parts, 0)).alias("image"), F.trim(F.get(parts, 1)).alias("label"), F.when(F.length(own) > 0, own).otherwise(named).alias("split"))
    return out.where((F.col("image") != "") & F.col("label").isNotNull())


def provenance_rows(files: DataFrame, known: DataFrame) -> DataFrame:
    """SRC-18: the latest record of each ingested file (path, source, bbox, acquired_at, retries, scene_id, url, records), with the retries added up over all its ingests."""
    every = known.unionByName(files)
    latest = F.max_by(F.struct("source", "bbox", "scene_id", "url", "records"), F.struct("acquired_at", "records"))
    return every.groupBy("path").agg(F.max("acquired_at").alias("acquired_at"), F.sum("retries").alias("retries"), latest.alias("l")).select("path", "acquired_at", "retries", "l.*")
