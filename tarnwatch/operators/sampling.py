"""Seeded samples and frames for training; order comes from hashes, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.operators.quantiles import with_quantiles, with_total


def _order(seed: int, key: str = "id"):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def ranked(rows: DataFrame, kind: str, seed: int) -> DataFrame:
    """Adds _k, each row's place (from 1) among those of its kind in seeded order.

    The order is cut into 4,096 slices; a place is that within a slice plus the
    rows of the slices before, so no window holds a whole kind.
    """
    cut = rows.withColumns({"_h": _order(seed), "_s": F.substring(_order(seed), 1, 3)})
    before = F.sum("_n").over(Window.partitionBy(kind).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    slices = cut.groupBy(kind, "_s").agg(F.count("*").alias("_n")).select(kind, "_s", F.coalesce(before, F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy(kind, "_s").orderBy("_h", "id")) + F.col("_b")
    return cut.join(slices, [kind, "_s"]).withColumn("_k", place).drop("_h", "_s", "_b")


def stratified_sample(rows: DataFrame, block: str, share: float, seed: int, total: int | None = None) -> DataFrame:
    """WN-09: round(n x share) rows of each block, in seeded order; with a ``total``, topped up to it from what is left."""
    quotas = rows.groupBy(block).agg(F.floor(F.count("*") * share + 0.5).alias("quota"))
    return quota_sample(rows, block, quotas, seed, total)


def quota_sample(rows: DataFrame, block: str, quotas: DataFrame, seed: int, total: int | None = None) -> DataFrame:
    """WN-09: the quota of each block (block, quota), in seeded order; with a ``total``, topped up to it from what is left of blocks with a quota."""
    places = ranked(rows, block, seed).join(quotas, block)
    own = F.col("_k") <= F.col("quota")
    taken, left = places.where(own).drop("_k", "quota"), places.where(~own).drop("_k", "quota")
    if total is None:
        return taken
    return taken.unionByName(left.orderBy(_order(seed), "id").limit(max(0, total - taken.count())))


def balanced_epoch(rows: DataFrame, kind: str, seed: int) -> DataFrame:
    """WN-10: as many rows of every kind as the largest has, drawn with replacement: (..., draw).

    A draw is a seeded digest of the kind and its number, modulo the kind's
    size, and takes the row of that place in seeded order. Draws are listed in
    parts of 4,096 and meet rows by kind and place, so no kind is one task's.
    """
    sizes = rows.groupBy(kind).agg(F.count("*").alias("_n"))
    most = F.broadcast(sizes.agg(F.max("_n").alias("_most")))  # one row
    parts = sizes.join(most, F.lit(True)).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_most") - 1) / 4096))))
    numbers = F.sequence(F.col("_p") * 4096 + 1, F.least(F.col("_most"), (F.col("_p") + 1) * 4096))
    draws = parts.select(F.col(kind).alias("_kind"), "_n", F.explode(numbers).alias("draw"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_kind").cast("string"), F.lit("")), F.col("draw").cast("string")))
    draws = draws.select("_kind", "draw", (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.col("_n") + 1).alias("_at"))
    places = ranked(rows, kind, seed)
    return draws.join(places, F.col("_kind").eqNullSafe(F.col(kind)) & (F.col("_at") == F.col("_k"))).select(*rows.columns, "draw")


def stratified_parts(rows: DataFrame, kind: str, shares: dict[str, float], rest: str, seed: int) -> DataFrame:
    """EV-19: each kind's rows (with an id) in seeded order into parts of floor(n x share) rows, and what is left into ``rest``."""
    sizes = rows.groupBy(kind).agg(F.count("*").alias("_n"))
    part, edge, edges = F.lit(rest), F.lit(0), []
    for name, share in shares.items():
        edge = edge + F.floor(F.col("_n") * share)
        edges.append((name, edge))
    for name, upto in reversed(edges):
        part = F.when(F.col("_k") <= upto, name).otherwise(part)
    return ranked(rows, kind, seed).join(sizes, kind).withColumn("part", part).drop("_k", "_n")


def event_halves(rows: DataFrame, event: str, seed: int) -> DataFrame:
    """EV-19: events in seeded order, in turn calibration and evaluation; all rows of an event are in one part."""
    events = rows.select(F.col(event).alias("id")).distinct().withColumn("_all", F.lit(1))
    side = ranked(events, "_all", seed).select(F.col("id").alias(event), F.when(F.col("_k") % 2 == 1, "calibration").otherwise("evaluation").alias("part"))
    return rows.join(side, event)


def named_holdout(rows: DataFrame, event: str, held: dict[str, tuple[str, ...]], rest: str = "train") -> DataFrame:
    """EV-19: rows of named events into the part that names them, all others into ``rest``."""
    part = F.lit(rest)
    for name, events in held.items():
        part = F.when(F.col(event).isin(*events), name).otherwise(part)
    return rows.withColumn("part", part)


def leaking_events(rows: DataFrame, event: str) -> DataFrame:
    """EV-19: events that have rows in more than one part."""
    return rows.groupBy(event).agg(F.countDistinct("part").alias("parts")).where("parts > 1")


def band_split(chips: DataFrame, bands: int = 5) -> DataFrame:
    """EV-19: lake chips (id, kind, row) by row into equal bands, every fifth band and the last whole one for validation; other chips train.

    A chip's place is that within its grid row plus the chips of the rows
    before, so no window holds all chips.
    """
    lakes = chips.where("kind = 'lake'")
    by_row = lakes.groupBy("row").agg(F.count("*").alias("_n"))
    before = by_row.select("row", F.coalesce(F.sum("_n").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # rows of the grid
    size = lakes.agg(F.greatest(F.floor(F.count("*") / bands), F.lit(1)).alias("_size"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("id")) - 1 + F.col("_b")
    band = F.floor(F.col("_place") / F.col("_size"))
    valid = lakes.join(before, "row").withColumn("_place", place).join(F.broadcast(size), F.lit(True)).select("id", ((band == bands - 1) | (band % 5 == 4)).alias("_v"))
    return chips.join(valid, "id", "left").withColumn("part", F.when(F.coalesce("_v", F.lit(False)), "val").otherwise("train")).drop("_v")


def chip_report(chips: DataFrame) -> DataFrame:
    """GR-43: chips and positive cells by kind and in all, with the range and middle of the lakes' elevations and areas; (kind, positive, elev_m, area_km2)."""
    rows = with_total(chips, "kind")
    spans = [f(c).alias(f"{c}_{n}") for c in ("elev_m", "area_km2") for n, f in (("min", F.min), ("max", F.max))]
    by = rows.groupBy("kind", "_total").agg(F.count("*").alias("chips"), F.count_if(F.col("positive") > 0).alias("with_positive"), F.max("positive").alias("positive_max"), *spans)
    middles = {f"{c}_median": c for c in ("positive", "elev_m", "area_km2")}
    by = with_quantiles(by, rows, ["kind", "_total"], middles, [0.5]).withColumns({c: F.col(c)[0] for c in middles})
    columns = [f"{c}_{n}" for c in ("elev_m", "area_km2") for n in ("min", "median", "max")]
    return by.select("kind", "chips", "with_positive", "positive_median", "positive_max", *columns)


def negative_dates(sites: DataFrame, events: DataFrame, k: int, clear_days: int, candidates: int, span_days: int, seed: int) -> DataFrame:
    """WN-11: k pseudo-dates of each site, not within some days of one of its events."""
    c = sites.select("site", F.explode(F.sequence(F.lit(1), F.lit(candidates))).alias("try"))
    at = F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col("site").cast("string"), F.col("try").cast("string"))), F.lit(span_days)).cast("int")
    c = c.withColumn("day", F.date_add(F.to_date(F.lit("1990-01-01")), at)).withColumn("try", F.col("try"))
    near = c.join(events.select("site", "event_date"), "site").where(F.abs(F.datediff("day", "event_date")) <= clear_days).select("site", "try").distinct()
    free = c.join(near, ["site", "try"], "left_anti")
    return free.withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy("try"))).where(F.col("_k") <= k).select("site", "day")


def sample_frame(parts: dict[str, DataFrame]) -> DataFrame:
    """WN-13: several kinds of samples with their common columns."""
    out = None
    for kind, df in parts.items():
        one = df.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def dataset_summary(rows: DataFrame, kind: str, label: str, id_col: str, features: tuple[str, ...] = ()) -> DataFrame:
    """WN-14: rows, positives, distinct ids and the positive share, by kind and overall; of features the mean and deviation over positives."""
    positive = F.col(label) == 1
    of = lambda f: F.when(positive, F.col(f))
    stats = [x for f in features for x in (F.avg(of(f)).alias(f"{f}_mean"), F.stddev_samp(of(f)).alias(f"{f}_std"))]
    return rows.rollup(kind).agg(F.count("*").alias("rows"), F.count_if(positive).alias("positive"), F.countDistinct(id_col).alias("ids"), F.avg(positive.cast("double")).alias("share"), *stats)


def power_law(rows: DataFrame, keys: list[str], default: tuple[float, float]) -> DataFrame:
    """ML-07: log V = a + b log A by least squares for each key; the default with fewer than two points."""
    p = rows.where((F.col("area") > 0) & (F.col("volume") > 0))
    fit = p.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.log("volume"), F.log("area")).alias("b"), F.regr_intercept(F.log("volume"), F.log("area")).alias("a"))
    few = (F.col("n") < 2) | F.col("b").isNull()
    return fit.select(*keys, "n", F.when(few, F.lit(default[1])).otherwise(F.col("b")).alias("exponent"), F.when(few, F.lit(default[0])).otherwise(F.exp("a")).alias("factor"))


def grouped_leave_one_out(rows: DataFrame, group: str) -> DataFrame:
    """ML-08: the power law of all other groups, from totals less the group's own sums: no loop over folds."""
    x, y = F.log("area"), F.log("volume")
    p = rows.where((F.col("area") > 0) & (F.col("volume") > 0))
    sums = p.groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    names = ("n", "x", "y", "xx", "xy")
    total = sums.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    o = sums.join(F.broadcast(total), F.lit(True)).select(group, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])
    spread = F.col("n") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(spread > 0, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / spread)
    return o.select(group, "n", slope.alias("exponent"), F.exp((F.col("y") - slope * F.col("x")) / F.col("n")).alias("factor"))
