"""Column expressions: scaling, indices, gates, classes, keys and geometry.

All of them return unrounded values; rounding is for presentation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
#: Metres of water stage for each severity.
WATER_STAGES = {"informational": 0.5, "watch": 0.5, "elevated": 2.0, "critical": 5.0}
#: Tolerance of each asset type in metres.
BUFFERS = {"bridge": 75.0, "road": 50.0, "settlement": 100.0, "well": 100.0}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def thousandths(x: Column) -> Column:
    """Rounded to three digits. Ties, and what lies within 1e-12 below one, go up, so that engines agree."""
    return F.floor(x * 1000.0 + 0.500000001) / 1000.0


def norm01(v: Column, low: float, high: float) -> Column:
    """FN-01: position of v between low and high, clamped; 0 where they are equal."""
    return F.lit(0.0) if high == low else clamp((v - F.lit(float(low))) / F.lit(float(high - low)))


def temp_index_piecewise(t: Column) -> Column:
    """FN-02: disease temperature index in four pieces; 0.5 where the temperature is missing."""
    return (
        F.when(t.isNull(), 0.5)
        .when(t < 5, 0.3)
        .when(t < 15, 0.4 + (t - 5) * 0.02)
        .when(t < 25, 0.6 + (t - 15) * 0.02)
        .otherwise(F.least(F.lit(1.0), 0.8 + (t - 25) * 0.01))
    )


def temp_index_linear(t: Column) -> Column:
    """FN-03: the other index, t / 20 clamped."""
    return clamp(t / 20.0)


def is_sar(sensor: Column) -> Column:
    return F.lower(sensor).contains("sentinel-1") | F.lower(sensor).contains("sar")


def quality_gate(cloud: Column, alignment: Column, sensor: Column) -> Column:
    """FN-04: struct of cloud, usable, alignment_ok, confidence and score."""
    effective = clamp(F.when(is_sar(sensor), 0.0).otherwise(cloud))
    aligned = alignment < 1.0
    fresh = F.when(F.lower(sensor).contains("nrt"), 1.0).otherwise(0.9)
    score = clamp((1.0 - effective) * 0.6 + F.when(aligned, 1.0).otherwise(0.5) * 0.4)
    return F.struct(
        effective.alias("cloud"),
        (effective < 0.20).alias("usable"),
        aligned.alias("alignment_ok"),
        ((1.0 - effective) * fresh).alias("confidence"),
        score.alias("score"),
    )


def route_sensor(cloud: Column, usable: Column) -> Column:
    """FN-05: struct of path, effective cloud and reason; unusable or cloudy scenes take the radar path."""
    radar = ~usable | (cloud >= 0.20)
    percent = F.format_string("optical cloud %.0f%% >= 20%% -> SAR path", cloud * 100)
    reason = F.when(cloud >= 0.20, percent).when(~usable, F.lit("optical unusable -> SAR path")).otherwise(F.lit("optical clear -> NDWI path"))
    return F.struct(F.when(radar, "sar").otherwise("optical").alias("path"), F.when(radar, 0.0).otherwise(cloud).alias("cloud"), reason.alias("reason"))


def in_scope(day: Column) -> Column:
    """FN-06: June to September."""
    return F.month(day).isin(6, 7, 8, 9)


#: Latitude below, longitude below, region; the first that fits is taken.
REGIONS = (
    (28.5, 82, "Western Himalaya"),
    (28.5, 89, "Central Himalaya"),
    (28.5, 999, "Eastern Himalaya"),
    (33, 78, "Western Himalaya"),
    (33, 85, "Central Himalaya"),
    (33, 999, "Tibetan Plateau"),
    (39, 75, "Hindu Kush"),
    (39, 80, "Karakoram"),
    (39, 999, "Pamir"),
    (999, 999, "Tien Shan"),
)


def region_of(lat: Column, lon: Column) -> Column:
    """FN-07: mountain region; a missing coordinate gives the plateau."""
    out = F.lit("Tibetan Plateau")
    for north, east, name in reversed(REGIONS):
        out = F.when((lat < north) & (lon < east), name).otherwise(out)
    return out


def proxy_slope(elevation: Column) -> Column:
    """FN-07: slope guessed from a lake's elevation."""
    return F.when(elevation >= 0, clamp(12.0 + (elevation - 3000) * 0.008, 5.0, 45.0)).otherwise(15.0)


def asset_type(tags: Column) -> Column:
    """FN-08: type of a mapped feature; place comes before bridge here."""
    tag = lambda k: F.element_at(tags, k)
    well = (tag("amenity") == "drinking_water") | (tag("man_made") == "water_well")
    return (
        F.when(tag("place").isin("village", "hamlet", "town"), "settlement")
        .when(tag("bridge") == "yes", "bridge")
        .when(well, "well")
        .when(tag("amenity").isin("clinic", "hospital"), "health")
        .when(tag("highway").isNotNull() & (tag("highway") != ""), "road")
        .otherwise("other")
    )


def asset_buffer(tags: Column) -> Column:
    """FN-08: tolerance in metres; bridge comes first here."""
    tag = lambda k: F.element_at(tags, k)
    well = (tag("amenity") == "drinking_water") | (tag("man_made") == "water_well")
    return (
        F.when(tag("bridge") == "yes", BUFFERS["bridge"])
        .when(tag("highway").isNotNull() & (tag("highway") != ""), BUFFERS["road"])
        .when(tag("place").isin("village", "hamlet", "town"), BUFFERS["settlement"])
        .when(well, BUFFERS["well"])
        .otherwise(100.0)
    )


def severity_stage(severity: Column) -> Column:
    """FN-09: water stage in metres; an unknown severity is an error."""
    stages = F.create_map(*[x for k, v in WATER_STAGES.items() for x in (F.lit(k), F.lit(v))])
    unknown = F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce(severity, F.lit("null"))))
    return F.coalesce(stages[severity], unknown.cast("double"))


def name_keys(name: Column) -> Column:
    """FN-10: keys to try in order: the name itself, then with one suffix left out."""
    key = F.lower(F.trim(name))
    tries = [key, *[F.regexp_replace(key, f"{s}$", "") for s in (" tsho", " co", " lake")]]
    return F.array_distinct(F.array(*tries))


def stable_id(text: Column, modulus: int, width: int, prefix: str) -> Column:
    """FN-11: crc32 of a text as a zero-padded number."""
    return F.concat(F.lit(prefix), F.lpad((F.crc32(F.encode(text, "UTF-8")) % modulus).cast("string"), width, "0"))


def unit_xyz(lat: Column, lon: Column) -> Column:
    """FN-12: point on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = unit_xyz(lat1, lon1), unit_xyz(lat2, lon2)
    chord = F.sqrt(sum((a[k] - b[k]) * (a[k] - b[k]) for k in ("x", "y", "z")))
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), chord / 2))


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def metres_per_degree(lat: Column) -> Column:
    return F.struct((F.lit(111320.0) * F.cos(F.radians(lat))).alias("east"), F.lit(110540.0).alias("north"))


def area_volume(area_m2: Column) -> Column:
    """FN-13: V = 0.104 A^1.421, 0 for no area."""
    return F.when(area_m2 > 0, 0.104 * F.pow(area_m2, F.lit(1.421))).otherwise(0.0)


def linear_to_db(x: Column, eps: float = 1e-10) -> Column:
    """FN-14"""
    return 10.0 * F.log10(F.greatest(x, F.lit(0.0)) + eps)


#: Offset, span, and whether a missing value becomes 0.
CHANNELS = {"sar": (-30.0, 30.0, False), "delta": (-15.0, 20.0, True), "dem": (0.0, 8848.0, True), "slope": (0.0, 90.0, True), "hand": (0.0, 200.0, True)}


def scale_channel(v: Column, channel: str) -> Column:
    """FN-15: value of a channel in [0, 1]."""
    low, span, fill = CHANNELS[channel]
    scaled = clamp((v - low) / span)
    scaled = F.when(v.isNotNull(), scaled)
    return F.coalesce(scaled, F.lit(0.0)) if fill else scaled


def unscale_channel(v: Column, channel: str) -> Column:
    low, span, _ = CHANNELS[channel]
    return v * span + low


def platt(p: Column, a: float, b: float) -> Column:
    """FN-16: 1 / (1 + exp(-(a p + b)))."""
    return 1.0 / (1.0 + F.exp(-(p * a + b)))


def interpolate(p: Column, knots: list[tuple[float, float]]) -> Column:
    """FN-16: piecewise-linear through the knots, clipped at both ends."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(p <= x1, y0 + (p - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(p <= knots[0][0], float(knots[0][1])).otherwise(out)


def odds_update(p_dynamic: Column, p_static: Column, base: float) -> Column:
    """FN-17: prior odds times the ratio of dynamic to base odds; a missing prior stays missing."""
    cut = lambda p: clamp(p, 1e-4, 1 - 1e-4)
    odds = lambda p: p / (1 - p)
    posterior = odds(cut(p_static)) * odds(cut(p_dynamic)) / (base / (1 - base))
    return F.when(p_static.isNotNull(), posterior / (1 + posterior))


def visibility_class(dark: Column, median_vv: Column) -> Column:
    """FN-18"""
    return F.when(dark > 0.5, "monitorable").when((dark < 0.2) & (median_vv > -12), "invisible").otherwise("marginal")


def log_features(area: Column, distance: Column, glacier_m2: Column) -> dict[str, Column]:
    """FN-19"""
    return {"log_area": F.log1p(area), "log_distance": F.log1p(F.greatest(distance, F.lit(0.0))), "log_glacier": F.log1p(glacier_m2 / 1e6)}


def area_bin(km2: Column, background: Column | None = None) -> Column:
    """FN-20: background cells count as medium."""
    size = F.when(km2 < 0.05, "micro").when(km2 < 0.5, "medium").otherwise("large")
    return size if background is None else F.when(background, "medium").otherwise(size)
