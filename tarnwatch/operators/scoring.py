"""Risk scores of runs, from features and exposures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions.scalars import clamp, norm01, thousandths

#: Weight of trend, expansion, rain, slope and drainage, and the value of each trend.
WEIGHTS = {"trend": 0.30, "expansion": 0.25, "rain": 0.20, "slope": 0.15, "drainage": 0.10}
TRENDS = {"stable": 0.1, "slowly": 0.4, "rapidly": 0.9, "uncertain": 0.3}
SETTLEMENTS = ("village", "settlement")
ROUTES = ("bridge", "road")


def hazard_parts(trend: Column, expansion: Column, rain_24h: Column, rain_7d: Column, slope: Column, drainage: Column) -> dict[str, Column]:
    t = F.lit(TRENDS["uncertain"])
    for k, v in TRENDS.items():
        t = F.when(trend == k, v).otherwise(t)
    return {
        "trend": t,
        "expansion": norm01(expansion, 0, 30),
        "rain": F.greatest(norm01(rain_24h, 0, 100), norm01(rain_7d, 0, 250) * 0.8),
        "slope": norm01(slope, 0, 45),
        "drainage": F.when(drainage, 1.0).otherwise(0.2),
    }


def hazard_score(parts: dict[str, Column]) -> Column:
    """SC-01: the weighted sum of the five parts, in thousandths."""
    total = None
    for k, w in WEIGHTS.items():
        total = w * parts[k] if total is None else total + w * parts[k]
    return thousandths(clamp(total))


def hazard_reasons(trend: Column, expansion: Column, rain_24h: Column, rain_7d: Column, slope: Column, drainage: Column, parts: dict[str, Column]) -> Column:
    part = lambda k: F.format_string(f"{WEIGHTS[k]}*%.2f", parts[k])
    return F.array(
        F.concat(F.lit("trend "), trend, F.lit(" adds "), part("trend")),
        F.concat(F.format_string("expansion %+.1f%% adds ", expansion), part("expansion")),
        F.concat(F.format_string("rain %.1f mm / %.1f mm adds ", rain_24h, rain_7d), part("rain")),
        F.concat(F.format_string("slope %.1f degrees adds ", slope), part("slope")),
        F.concat(F.when(drainage, "on").otherwise("off"), F.lit(" drainage adds "), part("drainage")),
    )


def severity(h: Column, population: Column, assets: Column, expansion: Column) -> Column:
    """SC-02"""
    return (
        F.when(expansion >= 40, "critical")
        .when((h >= 0.70) & ((assets > 0) | (population > 500)), "critical")
        .when(h >= 0.50, "elevated")
        .when(h >= 0.30, "watch")
        .otherwise("informational")
    )


def exposure_priority(h: Column, population: Column, assets: Column) -> Column:
    """SC-03, in thousandths"""
    return thousandths(h * (0.5 + 0.5 * norm01(population, 0, 2000)) * (0.5 + 0.5 * norm01(assets, 0, 10)))


def disease_risk(wells: Column, density: Column, temp_index: Column) -> Column:
    """SC-04, in thousandths"""
    return thousandths(norm01(wells, 0, 5) * (0.4 + 0.6 * norm01(density, 0, 500)) * temp_index)


def _access_loss() -> Column:
    route, near = F.col("asset_type").isin(*ROUTES), F.coalesce(F.col("distance_m") <= F.col("buffer_m"), F.lit(False))
    return F.max(F.when(route & F.col("inundated"), 1.0).when(route & near, 0.6).otherwise(0.3))


def exposure_rollup(exposures: DataFrame, default_population: int | None = None) -> DataFrame:
    """SC-06 and SC-09: what each run exposes, and how its access routes fare.

    People are those of settlements; villages are counted with them, without their people.
    """
    is_ = lambda *kinds: F.col("asset_type").isin(*kinds)
    people = F.sum(F.when(is_("settlement"), F.coalesce("population", F.lit(0))).otherwise(0))
    return exposures.groupBy("run_id").agg(
        (people if default_population is None else F.when(people == 0, F.lit(default_population)).otherwise(people)).alias("population"),
        F.count_if(is_(*SETTLEMENTS)).alias("settlements"),
        F.count_if(is_("bridge")).alias("bridges"),
        F.count_if(is_("well")).alias("wells"),
        F.count_if(is_("well") & F.col("inundated")).alias("inundated_wells"),
        _access_loss().alias("access_loss"),
    )


def access_label(access: Column) -> Column:
    return F.when(access >= 1.0, "cut").when(access >= 0.6, "at_risk").otherwise("accessible")


def fuse(runs: DataFrame) -> DataFrame:
    """SC-05: all scores of a run; needs the features and the rollup's columns.

    ``temp_index`` and ``density`` are columns too. Reasons are five, and three
    more where the severity is elevated or critical.
    """
    names = ("trend", "expansion", "rain_24h", "rain_7d", "slope", "drainage")
    args = [F.col(c) for c in names]
    parts = hazard_parts(*args)
    assets = F.col("settlements") + F.col("bridges") + F.col("wells")
    out = runs.withColumn("hazard", hazard_score(parts)).withColumn("assets", assets)
    out = out.withColumns(
        {
            "exposure": exposure_priority(F.col("hazard"), F.col("population"), F.col("assets")),
            "disease": disease_risk(F.col("inundated_wells"), F.col("density"), F.col("temp_index")),
            "severity": severity(F.col("hazard"), F.col("population"), F.col("assets"), F.col("expansion")),
            "confidence": F.when(F.col("trend") == "uncertain", 0.8).otherwise(0.9),
            "chlorine_tablets": F.col("population") * 28,
            "boil_water": F.col("inundated_wells") > 0,
        }
    )
    more = F.array(
        F.format_string("hazard %.2f scales exposure", F.col("hazard")),
        F.format_string("population %d exposed", F.col("population")),
        F.format_string("%d water points inundated", F.col("inundated_wells")),
    )
    reasons = hazard_reasons(*args, parts)
    return out.withColumn("reasons", F.when(F.col("severity").isin("elevated", "critical"), F.concat(reasons, more)).otherwise(reasons))


#: A fixed value: the distance of a village that has none, or that is 0.
NO_DISTANCE = 9999.0


def served_population(exposures: DataFrame) -> DataFrame:
    """SC-11: people a well serves: its own, else those of the village whose distance differs least, else of the smallest village.

    Of equally near villages the first of the run, by line and asset, counts. A
    run without villages serves nobody. A well that a run lists more than once
    on a line is one row: its most people, and the nearest village of any entry.
    """
    well, village = F.col("asset_type") == "well", F.col("asset_type") == "village"
    d = F.when(village, F.coalesce(F.nullif("distance_m", F.lit(0.0)), F.lit(NO_DISTANCE))).otherwise(F.col("distance_m"))
    people = F.coalesce("population", F.lit(0))
    run = Window.partitionBy("run_id")
    # running minima: of the villages up to a well, from either side, the nearest one and its first line
    side = lambda order, far: F.min(F.when(village, F.struct(far.alias("far"), "line", "asset_id", people.alias("p"), F.col("_d").alias("d")))).over(run.orderBy(order, well).rowsBetween(Window.unboundedPreceding, 0))
    gap = lambda v: F.when(v.isNotNull(), F.struct(F.abs(F.col("_d") - v["d"]).alias("gap"), v["line"].alias("line"), v["asset_id"].alias("asset_id"), v["p"].alias("p")))
    rows = exposures.where(well | village).withColumn("_d", d)
    rows = rows.withColumns({"_below": side(F.col("_d").asc(), -F.col("_d")), "_above": side(F.col("_d").desc(), F.col("_d")), "_smallest": F.min(F.when(village, people)).over(run)}).where(well)
    nearest = F.when(F.col("_d").isNotNull(), F.least(gap(F.col("_below")), gap(F.col("_above"))))
    wells = rows.select("run_id", F.col("asset_id").alias("well"), "line", people.alias("_own"), nearest.alias("_nearest"), "_smallest")
    one = wells.groupBy("run_id", "well", "line").agg(F.max("_own").alias("_own"), F.min("_nearest").alias("_nearest"), F.min("_smallest").alias("_smallest"))
    own = F.when(F.col("_own") > 0, F.col("_own"))
    served = F.when(F.col("_smallest").isNull(), 0).otherwise(F.coalesce(own, F.col("_nearest.p"), "_smallest"))
    return one.select("run_id", "well", "line", served.alias("served"))


def rescue_sectors(exposures: DataFrame) -> DataFrame:
    """SC-10: village, water-point and route sectors of each run, with their priority and place (villages by line, wells, routes).

    Exposures are rolled up once; both joins are on the run.
    """
    is_ = lambda *kinds: F.col("asset_type").isin(*kinds)
    people = lambda *kinds: F.sum(F.when(is_(*kinds), F.col("population")).otherwise(0))
    rolled = exposures.groupBy("run_id").agg(_access_loss().alias("access_loss"), people("village").alias("people"), people("well").alias("own"), F.count_if(is_("well")).alias("wells"), F.count_if(is_(*ROUTES)).alias("routes"))
    served = served_population(exposures).groupBy("run_id").agg(F.sum("served").alias("served"))
    place = lambda kind, line, asset: F.struct(F.lit(kind).alias("kind"), line.cast("long").alias("line"), asset.cast("long").alias("asset"))
    sector = lambda name, kind, n, u, k: F.struct(F.lit(name).alias("sector"), F.lit(kind).alias("kind"), n.cast("long").alias("population"), F.lit(u).alias("urgency"), place(k, F.lit(0), F.lit(0)).alias("place"))
    wells = F.when(F.col("wells") > 0, sector("water-points", "well", F.greatest("own", "served"), 0.7, 1))
    routes = F.when(F.col("routes") > 0, sector("access-routes", "bridge", F.col("people"), 0.5, 2))
    shared = rolled.join(served, "run_id", "left").select("run_id", "access_loss", F.inline(F.array_compact(F.array(wells, routes))))
    villages = exposures.where(is_("village")).select("run_id", F.concat_ws("-", F.lit("village"), "asset_id", "line").alias("sector"), F.lit("village").alias("kind"), F.coalesce("population", F.lit(0)).cast("long").alias("population"), F.lit(1.0).alias("urgency"), place(0, F.col("line"), F.col("asset_id")).alias("place"))
    every = villages.join(rolled.select("run_id", "access_loss"), "run_id").unionByName(shared)
    priority = thousandths(norm01(F.col("population"), 0, 2000) * F.col("access_loss") * F.col("urgency"))
    return every.select("run_id", "sector", "kind", "population", "access_loss", priority.alias("priority"), "place")


def personnel(exposures: DataFrame) -> DataFrame:
    """SC-12: head counts of each settlement; any severed route isolates all settlements of its run."""
    severed = exposures.groupBy("run_id").agg(F.count_if(F.col("asset_type").isin(*ROUTES) & F.col("inundated")).alias("severed"))
    people = exposures.where(F.col("asset_type").isin(*SETTLEMENTS) & (F.col("population") > 0)).join(severed, "run_id")
    accounted = F.floor(F.col("population") * F.when(F.col("severed") > 0, 0.935).otherwise(0.956))
    return people.select(
        "run_id", "asset_id", "line", "population", (F.col("severed") > 0).alias("isolated"), accounted.alias("accounted"), (F.col("population") - accounted).alias("unaccounted"),
        F.greatest(F.lit(1).cast("long"), F.floor(F.col("population") * 0.0113)).alias("medical"),
    )


def personnel_totals(people: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("population", "accounted", "unaccounted", "medical")]
    return people.rollup("run_id").agg(*sums)


def interval(p: Column, q: float) -> Column:
    """SC-13: p less and plus q within [0, 1]; a wide one asks for inspection."""
    low, high = clamp(p - q), clamp(p + q)
    return F.struct(low.alias("low"), high.alias("high"), (high - low > 0.35).alias("inspect"))


def top_reasons(contributions: Column, n: int = 3, p: Column | None = None, width: Column | None = None, widest: float = 0.35, raw: Column | None = None) -> Column:
    """SC-14: the n largest of array<struct<name, value>> by absolute value, as signed text; the probability and the width of its interval after them.

    ``raw`` (features of the same kind) takes the place of contributions that are null or empty.
    """
    ordered = F.array_sort(F.transform(contributions, lambda c: F.struct((-F.abs(c["value"])).alias("k"), c["name"].alias("name"), c["value"].alias("value"))))
    text = F.transform(F.slice(ordered, 1, n), lambda c: F.concat(c["name"], F.format_string(" %+.3f", c["value"])))
    if raw is not None:
        text = F.when(F.size(contributions) > 0, text).otherwise(F.transform(raw, lambda c: F.concat(c["name"], F.format_string(" %.3f", c["value"]))))
    more = [] if p is None else [F.format_string("probability %.3f", p)]
    if width is not None:
        more.append(F.concat(F.format_string("interval %.3f wide", width), F.when(width > widest, ", to be inspected").otherwise("")))
    return F.concat(text, F.array(*more)) if more else text


def pre_breach_warning(expansion: Column, p: Column, least: float = 0.65) -> Column:
    """SC-15"""
    return F.coalesce((expansion > 0) & (p >= least), F.lit(False))


def frozen_suppression(state: Column) -> Column:
    """SC-08: a frozen surface makes its layers unreliable and its drainage not hydrological."""
    frozen = state.isin("frozen_surface", "freeze_transition")
    return F.struct((~frozen).alias("layers_reliable"), (~frozen).alias("drainage_hydrological"))


def select_expansion(evidence: DataFrame, q: float) -> DataFrame:
    """SC-07: the model's expansion where all its gates hold, else the registered one; bounds and doubt with it."""
    gates = F.col("promoted") & F.col("descending") & F.col("covers") & F.col("in_scope") & ~F.col("frozen") & (F.col("baseline_km2") > 0)
    model = F.col("expansion_km2") / F.col("baseline_km2") * 100
    chosen = F.when(gates, model).otherwise(F.col("registered"))
    low = F.when(gates, model * (1 - q))
    return evidence.select("run_id", F.coalesce(gates, F.lit(False)).alias("from_model"), chosen.alias("expansion"), low.alias("low"), F.when(gates, model * (1 + q)).alias("high"), F.coalesce(low <= 0, F.lit(False)).alias("uncertain"))


def advisory_reasons(base: Column, notes: dict[str, Column]) -> Column:
    """SC-17: appends the notes whose condition holds, in order."""
    extra = F.array(*[F.when(c, F.lit(text)) for text, c in notes.items()])
    return F.concat(base, F.array_compact(extra))


def shadow_evidence(runs: DataFrame, scores: dict[str, DataFrame], least: float = 0.70) -> DataFrame:
    """SC-19: scores of several models side by side; the trigger needs an unfrozen lake and a score."""
    out = runs
    for name, s in scores.items():
        out = out.join(s.select("run_id", F.col("score").alias(name)), "run_id", "left")
    first = next(iter(scores))
    present = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in scores]))
    fired = F.coalesce((F.col(first) >= least) & ~F.col("frozen"), F.lit(False))
    return out.select("run_id", *scores, present.alias("components"), fired.alias("trigger"))
