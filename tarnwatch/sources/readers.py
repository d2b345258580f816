"""Readers of landed files, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE = "station long, daily struct<time: array<string>, precipitation_sum: array<double>, temperature_2m_mean: array<double>, temperature_2m_min: array<double>, temperature_2m_max: array<double>>"


def weather_archive_rows(documents: DataFrame) -> DataFrame:
    """SRC-01: (json) documents of parallel arrays -> a row for each station and day; nulls stay."""
    d = documents.select(F.from_json("json", ARCHIVE).alias("d")).select("d.station", F.inline(F.arrays_zip(*[F.col(f"d.daily.{c}").alias(c) for c in ("time", "precipitation_sum", "temperature_2m_mean", "temperature_2m_min", "temperature_2m_max")])))
    return d.select("station", F.to_date("time").alias("day"), F.col("precipitation_sum").alias("precip"), F.col("temperature_2m_mean").alias("tmean"), F.col("temperature_2m_min").alias("tmin"), F.col("temperature_2m_max").alias("tmax"))


def weather_power_rows(documents: DataFrame, missing: float = -900) -> DataFrame:
    """SRC-02: (station, json) with a map of day -> value for each parameter; fill values become null."""
    names = {"PRECTOTCORR": "precip", "T2M": "tmean", "T2M_MIN": "tmin", "T2M_MAX": "tmax"}
    m = documents.select("station", F.from_json("json", "map<string, map<string, double>>").alias("m"))
    long = m.select("station", F.explode("m").alias("name", "days")).select("station", "name", F.explode("days").alias("at", "v"))
    v = F.when(F.col("v") > missing, F.col("v"))
    return long.groupBy("station", F.to_date("at", "yyyyMMdd").alias("day")).agg(*[F.max(F.when(F.col("name") == k, v)).alias(c) for k, c in names.items()])


def date_map_series(documents: DataFrame) -> DataFrame:
    """SRC-03: (station, json) with days: {date: {mean_c, min_c}} -> rows."""
    d = documents.select("station", F.from_json("json", "days map<string, struct<mean_c: double, min_c: double>>").alias("d"))
    return d.select("station", F.explode("d.days").alias("at", "t")).select("station", F.to_date("at").alias("day"), F.col("t.mean_c").alias("tmean"), F.col("t.min_c").alias("tmin"))


def date_map_documents(rows: DataFrame) -> DataFrame:
    """SRC-03 reversed: rows (station, day, tmean, tmin) -> a document of dates for each station; some thousand days of a station are one row."""
    pair = F.struct(F.col("day").cast("string").alias("key"), F.struct(F.col("tmean").alias("mean_c"), F.col("tmin").alias("min_c")).alias("value"))
    by = rows.groupBy("station").agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("days"))
    return by.select("station", F.to_json(F.struct("days")).alias("json"))


def osm_elements_to_features(elements: DataFrame) -> DataFrame:
    """SRC-04: (id, kind, lat, lon, geometry array<struct<lon,lat>>, tags) -> features; what has no geometry goes."""
    n = F.size("geometry")
    closed = (n >= 4) & (F.element_at("geometry", 1) == F.element_at("geometry", -1))
    kind = F.when((F.col("kind") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull(), "Point").when((F.col("kind") == "way") & (n >= 2), F.when(closed, "Polygon").otherwise("LineString"))
    return elements.withColumn("shape", kind).where("shape IS NOT NULL")


def geojson_feature_rows(documents: DataFrame) -> DataFrame:
    """SRC-05: (json) feature collections -> shape, first vertex and properties."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    f = documents.select(F.explode(F.from_json("json", schema)["features"]).alias("f"))
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    first = lambda i: F.regexp_extract(F.col("f.geometry.coordinates"), rf"^[\[\s]*{number}\s*,\s*{number}", i).try_cast("double")
    return f.select(F.col("f.geometry.type").alias("shape"), first(1).alias("lon"), first(2).alias("lat"), F.col("f.properties").alias("properties"))


def event_catalogue_rows(rows: DataFrame, archive_start: str = "1981-01-01") -> DataFrame:
    """SRC-07: text columns lat, lon, year, month, day, area -> dated events; what cannot be read goes."""
    day = F.try_to_date(F.concat_ws("-", "year", F.lpad("month", 2, "0"), F.lpad("day", 2, "0")), "yyyy-MM-dd")
    area = F.col("area").try_cast("double")
    out = rows.select(F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), day.alias("event_date"), F.when(area > 0, area / 1e6).alias("area_km2"), F.lit(1).alias("breached"))
    return out.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("event_date") >= F.to_date(F.lit(archive_start))))


def lake_inventory(lakes: DataFrame, least_elevation: float, least_km2: float) -> DataFrame:
    """SRC-08"""
    return lakes.where((F.col("elev_m") >= least_elevation) & (F.col("area_m2") >= least_km2 * 1e6) & F.col("lat").isNotNull()).select("lake_id", "lat", "lon", "elev_m", (F.col("area_m2") / 1e6).alias("area_km2"))


def raster_cells(cells: DataFrame, box: tuple[int, int, int, int], step: int = 1) -> DataFrame:
    """SRC-14: cells of a window (first row, last row, first column, last column), each step-th of them."""
    r0, r1, c0, c1 = box
    inside = F.col("r").between(r0, r1) & F.col("c").between(c0, c1)
    return cells.where(inside & (F.col("r") % step == 0) & (F.col("c") % step == 0))


def tile_list(boxes: DataFrame) -> DataFrame:
    """SRC-15: names of the one-degree tiles that cover each box (box, south, north, west, east)."""
    side = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int")))
    t = boxes.select("box", side("south", "north").alias("lat"), "west", "east").select("box", "lat", side("west", "east").alias("lon"))
    name = F.concat(F.when(F.col("lat") < 0, "S").otherwise("N"), F.lpad(F.abs("lat").cast("string"), 2, "0"), F.when(F.col("lon") < 0, "W").otherwise("E"), F.lpad(F.abs("lon").cast("string"), 3, "0"))
    return t.withColumn("tile", name)


def granule_list(spans: DataFrame, prefix: str) -> DataFrame:
    """SRC-15: names of the daily granules of each span (span, first, last), by year and day of the year; none where it ends before it starts."""
    days = spans.where("first <= last").select("span", F.explode(F.sequence("first", "last")).alias("day"))
    return days.select("span", "day", F.concat(F.lit(prefix), F.date_format("day", "yyyy"), F.lit("."), F.lpad(F.dayofyear("day").cast("string"), 3, "0")).alias("granule"))


def complete_samples(members: DataFrame, required: list[str]) -> DataFrame:
    """SRC-13: (path) of shard members -> sample ids that have every required field."""
    parts = members.select(F.regexp_extract("path", r"([^/.]+)\.([^/]+)$", 1).alias("sample"), F.regexp_extract("path", r"([^/.]+)\.([^/]+)$", 2).alias("field"))
    by = parts.groupBy("sample").agg(F.collect_set("field").alias("fields"))
    return by.where(F.size(F.array_except(F.array(*map(F.lit, required)), "fields")) == 0).select("sample")


def report(rows: DataFrame, key: str, id_col: str, most: int = 10_000) -> DataFrame:
    """SRC-17: totals of each key with its nested items, as JSON texts of some ``most`` items each, dealt by hash."""
    totals = rows.groupBy(key).agg(F.count("*").alias("n"))
    parts = rows.select(key, id_col).join(totals, key).withColumn("part", F.pmod(F.xxhash64(id_col), F.ceil(F.col("n") / most)).cast("int"))
    by = parts.groupBy(key, "n", "part").agg(F.sort_array(F.collect_list(id_col)).alias("items"))
    return by.select(key, F.to_json(F.struct(key, "n", "part", "items")).alias("report"))
