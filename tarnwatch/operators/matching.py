"""Matches of labels, catalogues and estimates, and lookups on grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import area_volume, name_keys
from tarnwatch.operators.grid import gamma0, local_incidence_cos, sigma0_db, slope_degrees

#: Label tiers, best first.
LABEL_TIERS = ("gold", "auto", "merged")


def label_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """JN-08: best label tier of both dates of (pair_id, d1, d2), and whether gold labels are complete."""
    tier = F.array_position(F.array(*map(F.lit, LABEL_TIERS)), F.col("tier"))
    best = labels.groupBy("day").agg(F.min(tier).alias("rank")).withColumn("tier", F.when(F.col("rank").isNotNull(), F.element_at(F.array(*map(F.lit, LABEL_TIERS)), F.col("rank").cast("int"))))
    one = best.select(F.col("day").alias("d1"), F.col("tier").alias("tier_1"))
    two = best.select(F.col("day").alias("d2"), F.col("tier").alias("tier_2"))
    gold = F.coalesce((F.col("tier_1") == "gold").cast("int"), F.lit(0)) + F.coalesce((F.col("tier_2") == "gold").cast("int"), F.lit(0))
    return pairs.join(one, "d1", "left").join(two, "d2", "left").select("pair_id", "tier_1", "tier_2", F.when(gold == 2, "complete").when(gold == 1, "incomplete").otherwise("missing").alias("gold"))


def eligible_pairs(pairs: DataFrame, labels: DataFrame, use: str) -> DataFrame:
    """JN-08: pairs (pair_id, d1, d2, uses: array) that may be used so: complete or incomplete in gold labels; missing where a label or the permission is."""
    found = label_pairs(pairs, labels).join(pairs.select("pair_id", F.coalesce(F.array_contains("uses", use), F.lit(False)).alias("_may")), "pair_id")
    usable = F.col("_may") & F.col("tier_1").isNotNull() & F.col("tier_2").isNotNull()
    return found.select("pair_id", "tier_1", "tier_2", F.when(~usable, "missing").when(F.col("gold") == "complete", "complete").otherwise("incomplete").alias("state"))


def catalogue_matches(surveyed: DataFrame, published: DataFrame) -> DataFrame:
    """JN-10: (id, name, volume) against (seq, name, volume) by name key, then with a suffix left out; the last catalogue row of a name wins."""
    keys = surveyed.select("id", "volume", F.posexplode(name_keys(F.col("name"))).alias("priority", "key"))
    last = published.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max_by("volume", "seq").alias("published"))
    found = keys.join(last, "key").groupBy("id").agg(F.min_by("published", "priority").alias("published"), F.first("volume").alias("volume"))
    return found.select("id", "published", ((F.col("volume") - F.col("published")) / F.col("published") * 100).alias("percent"))


def volume_estimates(lakes: DataFrame, matched: DataFrame) -> DataFrame:
    """JN-11: the published volume where matched, else the surveyed one, and which of them it is."""
    j = lakes.join(matched.select("id", "published"), "id", "left")
    own = F.col("mean_depth") * F.col("area_m2")
    return j.select("id", F.coalesce("published", own, area_volume(F.col("area_m2"))).alias("volume"), F.when(F.col("published").isNotNull(), "published").when(own.isNotNull(), "surveyed").otherwise("law").alias("source"))


def exposure_view(exposures: DataFrame, assets: DataFrame) -> DataFrame:
    """JN-13: exposures with their asset's name and class, nearest first within a run."""
    return exposures.join(assets, "asset_id").select("run_id", "asset_id", "line", "name", "asset_class", "distance_m").orderBy("run_id", "distance_m", "asset_id", "line")


def seasonal_negative_dates(sites: DataFrame, positives: DataFrame, seed: int) -> DataFrame:
    """WN-12: each site takes the date of a positive, drawn by hash."""
    ranked = positives.select("event_date", F.pmod(F.crc32(F.col("event_id").cast("string")), F.lit(64)).alias("slot"), "event_id")
    order = Window.partitionBy("slot").orderBy("event_id")
    ranked = ranked.withColumns({"k": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("slot"))})
    slots = ranked.select("slot", "n").distinct().withColumn("i", F.row_number().over(Window.orderBy("slot")) - 1)  # 64 rows at most
    many = slots.agg(F.count("*").alias("m"))
    draw = F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col("site").cast("string")))
    s = sites.withColumn("_h", draw).join(F.broadcast(many), F.lit(True)).withColumn("i", F.pmod("_h", "m"))
    s = s.join(F.broadcast(slots), "i").withColumn("k", F.pmod(F.floor(F.col("_h") / 64), "n"))
    return s.join(ranked.select("slot", "k", "event_date"), ["slot", "k"]).select("site", "event_date")


#: Parts into which the cells of a key are dealt where they meet one row of it.
SALTS = 64


def lut_bilinear(cells: DataFrame, table: DataFrame, row_step: int, col_step: int, keys: Sequence[str] = ()) -> DataFrame:
    """GR-09, GR-15: values of a sparse (line, pixel, value) lookup on a regular raster, at every cell; ``keys`` (scene, band) have a table each.

    A cell joins the four corners of its box by equality; beyond the last
    corner the nearest one counts. A key's last corner is one row for each of
    its salts, so that no task takes all cells of a scene or band.
    """
    last = table.groupBy(*keys).agg(F.max("line").alias("_l"), F.max("pixel").alias("_p"))
    c = cells.select(*keys, "r", "c")
    if keys:
        last = last.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        c = c.withColumn("_s", F.pmod(F.xxhash64("r", "c"), F.lit(SALTS)).cast("int"))
    c = c.join(last, [*keys, "_s"]).drop("_s") if keys else c.join(F.broadcast(last), F.lit(True))
    low_r, low_c = F.least(F.floor(F.col("r") / row_step) * row_step, F.col("_l")), F.least(F.floor(F.col("c") / col_step) * col_step, F.col("_p"))
    c = c.withColumns({"r0": low_r, "c0": low_c, "r1": F.least(low_r + row_step, F.col("_l")), "c1": F.least(low_c + col_step, F.col("_p"))})
    fr = F.when(F.col("r1") > F.col("r0"), (F.col("r") - F.col("r0")) / row_step).otherwise(0.0)
    fc = F.when(F.col("c1") > F.col("c0"), (F.col("c") - F.col("c0")) / col_step).otherwise(0.0)
    corner = lambda a, b, w: F.struct(F.col(a).alias("line"), F.col(b).alias("pixel"), w.alias("w"))
    corners = F.array(corner("r0", "c0", (1 - fr) * (1 - fc)), corner("r0", "c1", (1 - fr) * fc), corner("r1", "c0", fr * (1 - fc)), corner("r1", "c1", fr * fc))
    return c.select(*keys, "r", "c", F.inline(corners)).join(table, [*keys, "line", "pixel"]).groupBy(*keys, "r", "c").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def calibrated_scenes(cells: DataFrame, table: DataFrame, terrain: DataFrame, keys: Sequence[str], *, row_step: int, col_step: int, cell_m: float, incidence_deg: float, azimuth_deg: float) -> DataFrame:
    """GR-55: terrain-corrected backscatter of all scenes and bands at once, from raw cells (keys, r, c, dn), their lookups and elevations (r, c, z) on the same grid.

    Lookup, decibels, slope and correction follow each other as one plan. Where
    there is no elevation the backscatter stays as it is.
    """
    looked = lut_bilinear(cells, table, row_step, col_step, keys).join(cells.select(*keys, "r", "c", "dn"), [*keys, "r", "c"])
    s = slope_degrees(terrain, cell_m).select("r", "c", "nx", "ny", "nz")
    db = looked.withColumn("db", sigma0_db(F.col("dn"), F.col("value"))).join(s, ["r", "c"], "left")
    k = local_incidence_cos(F.col("nx"), F.col("ny"), F.col("nz"), incidence_deg, azimuth_deg)
    return db.select(*keys, "r", "c", gamma0(F.col("db"), F.coalesce(k, F.lit(0.0))).alias("gamma"))


def channel_stack(bands: DataFrame, names: list[str]) -> DataFrame:
    """GR-22: (r, c, band, value) -> one array for each cell that has every band."""
    by = bands.groupBy("r", "c").agg(*[F.max(F.when(F.col("band") == n, F.col("value"))).alias(n) for n in names])
    return by.na.drop(subset=names).select("r", "c", F.array(*names).alias("channels"))


def region_metrics(rows: DataFrame, region: str, truth: Column, predicted: Column) -> DataFrame:
    """EV-04: IoU, precision and recall in each region; null where nothing is there."""
    c = rows.groupBy(region).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"))
    over = lambda a, b: F.col("tp") / F.nullif(b, F.lit(0))
    return c.select(region, over("tp", F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"), over("tp", F.col("tp") + F.col("fp")).alias("precision"), over("tp", F.col("tp") + F.col("fn")).alias("recall"))


def change_metrics(rows: DataFrame, keys: list[str], label_0: Column, label_1: Column, p0: Column, p1: Column, valid: Column) -> DataFrame:
    """EV-05: labelled and predicted change where both dates are valid."""
    truth, found = label_1 & ~label_0, (p1 >= 0.5) & (p0 < 0.5)
    return rows.where(valid).groupBy(*keys).agg(
        F.count_if(truth & found).alias("tp"), F.count_if(~truth & found).alias("fp"), F.count_if(truth).alias("labelled"), F.sum(F.greatest(F.lit(0.0), p1 - p0)).alias("positive_mass")
    )


def drawdown_vs_truth(measured: DataFrame, low: float, high: float) -> DataFrame:
    """GR-46: (id, volume) against a documented range: error to its middle and whether it lies within."""
    middle = (low + high) / 2
    return measured.select("id", ((F.col("volume") - middle) / middle * 100).alias("percent_error"), F.col("volume").between(low, high).alias("in_range"))


def stac_item_rows(items: DataFrame) -> DataFrame:
    """SRC-06: catalogue items (json) -> scene metadata; the first asset that has a link counts."""
    schema = "id string, properties map<string, string>, assets map<string, struct<href: string>>"
    i = items.select(F.from_json("json", schema).alias("i"))
    asset = lambda k: F.element_at("i.assets", k)["href"]
    prop = lambda *ks: F.coalesce(*[F.element_at("i.properties", k) for k in ks])
    return i.select(
        F.col("i.id").alias("scene_id"), F.coalesce(asset("data"), asset("product"), asset("download")).alias("href"), prop("sat:orbit_state", "orbitDirection").alias("orbit"),
        F.coalesce(prop("productType"), F.lit("GRD")).alias("product"), F.coalesce(prop("polarisation"), F.lit("VV")).alias("polarisation"),
    )
