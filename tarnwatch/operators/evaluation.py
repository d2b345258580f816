"""Evaluation of scores, masks and estimates. Curves come from counts of distinct scores, not from sorted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.operators.quantiles import grouped_quantiles, with_quantiles, with_total


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and ``empty`` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def confusion(keys: list[str], rows: DataFrame, truth: Column, predicted: Column, valid: Column | None = None) -> DataFrame:
    rows = rows if valid is None else rows.where(valid)
    return rows.groupBy(*keys).agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn")
    )


def confusion_metrics(counts: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """EV-01: IoU, precision, recall and F1 of tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"iou": ratio(tp, tp + fp + fn, empty), "precision": ratio(tp, tp + fp, empty), "recall": ratio(tp, tp + fn, empty), "f1": ratio(2 * tp, 2 * tp + fp + fn, empty)}
    )


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float], chip: str, gate: float = 0.65) -> DataFrame:
    """EV-02: pooled metrics, and mean and median IoU of chips, at each threshold; (chip, label, score).

    Each row is counted once, in the highest threshold it reaches; the counts
    of a threshold are sums over the levels, so rows are not multiplied.
    """
    level = sum((F.col("score") >= t).cast("int") for t in thresholds)
    counts = rows.groupBy(chip, level.alias("level")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    up = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(i + 1).alias("least")) for i, t in enumerate(sorted(thresholds))]))
    at = counts.select("*", up.alias("t"))
    reached = F.col("level") >= F.col("t.least")
    chips = at.groupBy(chip, F.col("t.tau").alias("tau")).agg(
        F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(reached, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~reached, F.col("pos")).otherwise(0)).alias("fn")
    )
    chips = confusion_metrics(chips)
    pooled = chips.groupBy("tau").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("iou").alias("mean_iou"), F.percentile("iou", F.lit(0.5)).alias("median_iou"))
    return confusion_metrics(pooled).withColumn("passed", F.col("iou") > gate)


def best_by_iou(sweep: DataFrame) -> DataFrame:
    """EV-02: the row of a sweep with the largest pooled IoU, the lowest threshold of equal ones. A sweep has one short row for each threshold."""
    return sweep.orderBy(F.desc("iou"), "tau").limit(1)


def event_metrics(rows: DataFrame, event: str, chip: str) -> DataFrame:
    """EV-03: before and after a filter, for each chip, event and all; (event, chip, truth, before, after)."""
    cut = lambda p: [F.count_if(F.col("truth") & F.col(p)), F.count_if(~F.col("truth") & F.col(p)), F.count_if(F.col("truth") & ~F.col(p))]
    names = ("tp", "fp", "fn")
    aggs = [c.alias(f"{n}_{p}") for p in ("before", "after") for n, c in zip(names, cut(p), strict=True)]
    out = rows.rollup(event, chip).agg(*aggs)
    iou = lambda p: ratio(F.col(f"tp_{p}"), F.col(f"tp_{p}") + F.col(f"fp_{p}") + F.col(f"fn_{p}"))
    return out.select(event, chip, (iou("after") - iou("before")).alias("iou_gain"), (F.col("fp_before") - F.col("fp_after")).alias("fp_removed"), (F.col("tp_before") - F.col("tp_after")).alias("tp_removed"))


def _distinct_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))


#: Scores lie in [0, 1]; a prefix sum runs over so many ranges of them first.
RANGES = 1024


def cumulative(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct score: positives and negatives at it and above it.

    Two levels of running sums: over 1,024 ranges of scores, and within a
    range. So no window holds more than the scores of one range.
    """
    s = _distinct_scores(rows, keys).withColumn("_range", F.floor(F.col("score") * RANGES).cast("int"))
    ranges = s.groupBy(*keys, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"_pa": F.coalesce(F.sum("_p").over(above), F.lit(0)), "_na": F.coalesce(F.sum("_n").over(above), F.lit(0))})
    within = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(ranges.drop("_p", "_n"), [*keys, "_range"])
    return out.select(*keys, "score", "pos", "neg", (F.sum("pos").over(within) + F.col("_pa")).alias("tp"), (F.sum("neg").over(within) + F.col("_na")).alias("fp"))


def rank_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EV-08, EV-11: AUC with midranks, average precision and Brier score for each key; null where a class is missing."""
    c = cumulative(rows, keys)
    totals = rows.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("P"), F.count_if(F.col("label") != 1).alias("N"), F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"))
    below = F.col("neg") / 2 + F.lit(0.0)
    sums = c.groupBy(*keys).agg(F.sum(F.col("pos") * (below - F.col("fp"))).alias("_s"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"))
    out = sums.join(totals, keys)
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return out.select(*keys, F.when(both, (F.col("_s") + F.col("P") * F.col("N")) / (F.col("P") * F.col("N"))).alias("auc"), F.when(F.col("P") > 0, F.col("_ap") / F.col("P")).alias("average_precision"), "brier")


def best_threshold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EV-09: the score and the side of it (above or below, the score itself left out) at which F1 is best.

    Of equal ones the lowest score counts, and above before below; 0 and above
    where no F1 is over 0.
    """
    totals = rows.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("P"), F.count_if(F.col("label") != 1).alias("N"))
    side = lambda order, name, tp, fp: F.struct(F.lit(order).alias("order"), F.lit(name).alias("direction"), tp.alias("tp"), fp.alias("fp"))
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("P")
    sides = F.array(side(0, "gt", tp - F.col("pos"), fp - F.col("neg")), side(1, "lt", p - tp, F.col("N") - fp))
    c = cumulative(rows, keys).join(totals, keys).select(*keys, "score", "P", F.explode(sides).alias("s")).select(*keys, "score", "P", "s.*")
    f1 = 2.0 * tp / (tp + fp + p)
    best = c.groupBy(*keys).agg(F.min(F.when(tp > 0, F.struct((-f1).alias("worse"), "score", "order", "direction", "tp", "fp", "P"))).alias("b"))
    over = lambda n: F.coalesce(F.col("b.tp") / n, F.lit(0.0))
    return best.select(
        *keys, F.coalesce("b.score", F.lit(0.0)).alias("threshold"), F.coalesce("b.direction", F.lit("gt")).alias("direction"), F.coalesce(-F.col("b.worse"), F.lit(0.0)).alias("f1"),
        over(F.col("b.tp") + F.col("b.fp")).alias("precision"), over(F.col("b.P")).alias("recall"),
    )


def separability(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EV-10: Fisher ratio of two populations (label 1 and 0), their means, and the share of each above 0."""
    a, b = F.when(F.col("label") == 1, F.col("score")), F.when(F.col("label") != 1, F.col("score"))
    above = lambda x: F.avg((x > 0).cast("double"))
    out = rows.groupBy(*keys).agg(F.avg(a).alias("mean_1"), F.avg(b).alias("mean_0"), F.var_pop(a).alias("_v1"), F.var_pop(b).alias("_v0"), above(a).alias("share_1"), above(b).alias("share_0"))
    gap = F.col("mean_1") - F.col("mean_0")
    return out.withColumn("fisher", gap * gap / F.greatest(F.col("_v1") + F.col("_v0"), F.lit(1e-9))).drop("_v1", "_v0")


TIERS = ("informational", "watch", "elevated", "critical")


def tier_of(score: Column, cuts: Sequence[float]) -> Column:
    out = F.lit(TIERS[0])
    for name, cut in zip(TIERS[1:], cuts, strict=True):
        out = F.when(score >= cut, name).otherwise(out)
    return out


def tier_table(rows: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """EV-12: rows, events and rate of each tier that occurs, and whether rates rise with the tiers so far."""
    by = rows.groupBy(tier_of(F.col("score"), cuts).alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("events"))
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")).cast("int")
    rate = F.col("events") / F.col("n")
    before = F.lag(rate).over(Window.orderBy(rank))  # four rows at most
    return by.select("tier", "n", "events", rate.alias("rate"), F.coalesce(rate >= before, F.lit(True)).alias("rises"))


def boundary_metrics(rows: DataFrame, cut: float) -> DataFrame:
    """EV-13: recall, false-alarm rate, precision, F1 and missed at a boundary; null where nothing is there."""
    c = confusion([], rows, F.col("label") == 1, F.col("score") >= cut)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(ratio(tp, tp + fn, None).alias("recall"), ratio(fp, fp + tn, None).alias("false_alarms"), ratio(tp, tp + fp, None).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn, None).alias("f1"), fn.alias("missed"))


def threshold_at_far(rows: DataFrame, keys: list[str], far: float) -> DataFrame:
    """EV-14: the score that leaves a share ``far`` of negatives above it, and the recall there."""
    negative = F.when(F.col("label") != 1, F.col("score"))
    cut = grouped_quantiles(rows, keys, {"threshold": negative}, [1 - far]).withColumn("threshold", F.col("threshold")[0])
    joined = rows.join(cut, keys) if keys else rows.join(F.broadcast(cut), F.lit(True))
    pos, up = F.col("label") == 1, F.col("score") >= F.col("threshold")
    return joined.groupBy(*keys, "threshold").agg(ratio(F.count_if(pos & up), F.count_if(pos), None).alias("recall"), ratio(F.count_if(~pos & up), F.count_if(~pos), None).alias("false_alarms"))


def over_folds(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """EV-11: mean and population deviation of each metric over the folds that have it."""
    return metrics.agg(*[f(n).alias(f"{n}_{x}") for n in names for x, f in (("mean", F.avg), ("std", F.stddev_pop))])


def recall_at_false_alarms(inner: DataFrame, test: DataFrame, fold: str, shares: Sequence[float]) -> DataFrame:
    """EV-14: recall and false alarms of each fold's test rows at thresholds from its inner scores, as means over folds and pooled.

    Both have (fold, label, score). Folds whose inner rows hold no negative or
    whose test rows hold one class only are left out. Thresholds of all shares
    are tried side by side, so rows are not multiplied.
    """
    cut = grouped_quantiles(inner, [fold], {"_cut": F.when(F.col("label") != 1, F.col("score"))}, [1 - f for f in shares])
    pos, up = F.col("label") == 1, lambda i: F.col("score") >= F.col("_cut")[i]
    counts = [F.struct(F.lit(float(f)).alias("share"), F.count_if(pos & up(i)).alias("tp"), F.count_if(~pos & up(i)).alias("fp")) for i, f in enumerate(shares)]
    by = test.join(cut.where(F.col("_cut").isNotNull()), fold).groupBy(fold).agg(F.count_if(pos).alias("events"), F.count_if(~pos).alias("others"), F.array(*counts).alias("at"))
    by = by.where("events > 0 AND others > 0").select("events", "others", F.inline("at"))
    return by.groupBy("share").agg(
        F.count("*").alias("folds"), F.avg(F.col("tp") / F.col("events")).alias("mean_recall"), F.avg(F.col("fp") / F.col("others")).alias("mean_false_alarms"),
        (F.sum("tp") / F.sum("events")).alias("recall"), (F.sum("fp") / F.sum("others")).alias("false_alarms"),
    )


def _residuals(rows: DataFrame, key: str) -> DataFrame:
    """Counts of distinct residuals of each group, with the range of each and the number of all."""
    own = rows.select(key, F.abs(F.col("score") - F.col("label")).alias("e")).groupBy("e", key).agg(F.count("*").alias("c"))
    widest = own.agg(F.max("e").alias("widest"), F.sum("c").alias("all"))
    return own.join(F.broadcast(widest), F.lit(True)).withColumn("range", F.when(F.col("widest") > 0, F.floor(F.col("e") / F.col("widest") * (RANGES - 1))).otherwise(0).cast("int"))


def _residual_quantiles(own: DataFrame, key: str, groups: DataFrame, alpha: float) -> DataFrame:
    """The residual quantile of all rows less those of each of the groups (key, all, n); a null key has no rows."""
    level = F.least(F.ceil((F.col("m") + 1) * (1 - alpha)) / F.col("m"), F.lit(1.0))
    at = level * (F.col("m") - 1)
    groups = groups.withColumn("m", F.col("all") - F.col("n")).withColumns({"low": F.floor(at) + 1, "high": F.ceil(at) + 1, "w": at - F.floor(at)})
    by_range = own.groupBy("range").agg(F.sum("c").alias("t"))  # 1,024 rows at most, each beside each group
    grid = groups.join(F.broadcast(by_range), F.lit(True)).join(own.groupBy("range", key).agg(F.sum("c").alias("o")), ["range", key], "left")
    upto = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("others", F.col("t") - F.coalesce("o", F.lit(0))).withColumn("upto", F.sum("others").over(upto))
    holds = lambda k: (F.col("upto") >= F.col(k)) & (F.col("upto") - F.col("others") < F.col(k))
    wanted = grid.where(holds("low") | holds("high")).select(key, "range", "low", "high", "w", (F.col("upto") - F.col("others")).alias("before"))
    inner = own.groupBy("range", "e").agg(F.sum("c").alias("t")).join(wanted, "range").join(own.select("e", key, "c"), ["e", key], "left")
    seen = F.col("before") + F.sum(F.col("t") - F.coalesce("c", F.lit(0))).over(Window.partitionBy(key, "range").orderBy("e").rowsBetween(Window.unboundedPreceding, 0))
    inner = inner.withColumn("seen", seen)
    q = inner.groupBy(key).agg(F.min(F.when(F.col("seen") >= F.col("low"), F.col("e"))).alias("a"), F.min(F.when(F.col("seen") >= F.col("high"), F.col("e"))).alias("b"), F.first("w").alias("w"))
    return q.select(key, (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("q"))


def _coverage(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "q").agg((F.sum(F.when(F.col("e") <= F.col("q"), F.col("c")).otherwise(0)) / F.sum("c")).alias("coverage"))


def conformal_quantiles(rows: DataFrame, key: str, alpha: float) -> DataFrame:
    """EV-15 to EV-17: the residual quantile without each group's own rows, and how well it covers the group.

    A group's held-out counts are the totals less its own, so rows never meet
    the rows of other groups. Residuals are counted in 1,024 ranges first: of
    each group only the ranges that hold its two order statistics are searched.
    """
    own = _residuals(rows, key)
    q = _residual_quantiles(own, key, own.groupBy(key, "all").agg(F.sum("c").alias("n")), alpha)
    return _coverage(own.join(q, key), key).withColumn("passed", F.abs(F.col("coverage") - (1 - alpha)) <= 0.05)


def conformal_summary(rows: DataFrame, key: str, alpha: float, least_groups: int = 3) -> DataFrame:
    """EV-17: the quantile of all rows and its coverage, the least and largest coverage of a held-out group, and whether enough groups all pass."""
    own = _residuals(rows, key)
    whole = own.select(F.lit(None).cast(rows.schema[key].dataType).alias(key), "all", F.lit(0).cast("long").alias("n")).limit(1)
    pooled = _coverage(own.join(F.broadcast(_residual_quantiles(own, key, whole, alpha).select("q")), F.lit(True)))
    groups = conformal_quantiles(rows, key, alpha).agg(F.count("*").alias("groups"), F.min("coverage").alias("least"), F.max("coverage").alias("largest"), F.bool_and("passed").alias("_all"))
    return pooled.join(F.broadcast(groups), F.lit(True)).select("q", "coverage", "groups", "least", "largest", (F.col("_all") & (F.col("groups") >= least_groups)).alias("passed"))


def ape_summary(rows: DataFrame, kind: str, gate: float = 0.15) -> DataFrame:
    """EV-18: absolute percentage errors by kind and overall; (kind, truth, estimate)."""
    e = rows.where(F.col("truth") > 0).withColumn("ape", F.abs(F.col("estimate") - F.col("truth")) / F.col("truth"))
    e = with_total(e, kind)
    by = with_quantiles(e.groupBy(kind, "_total").agg(F.count("*").alias("n"), F.avg("ape").alias("mean_ape")), e, [kind, "_total"], {"median_ape": "ape"}, [0.5])
    return by.select(kind, "n", "mean_ape", F.col("median_ape")[0].alias("median_ape"), (F.col("mean_ape") < gate).alias("passed"))


def distribution_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """WN-15"""
    by = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    by = with_quantiles(by, rows, keys, {"_p": value}, [0.05, 0.5, 0.95])
    return by.select(*keys, "n", "mean", "std", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


#: Gates of the mean Brier score and of the water IoU.
BRIER_GATE, WATER_GATE = 0.15, 0.65


def shadow_summary(rows: DataFrame) -> DataFrame:
    """EV-20: averages over runs with their gates, and whether all that have a gate and a value pass.

    (brier, p, width, iou: null where a run has none; triggered, evidence:
    boolean). A mean Brier score must be below its gate, an IoU at least its
    gate. Without any gated value the whole does not pass.
    """
    share = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), F.lit(0.0))
    means = rows.agg(*[F.avg(c).alias(c) for c in ("brier", "p", "width", "iou")], share("triggered").alias("triggered"), share("evidence").alias("evidence"))
    gates = {"brier": (BRIER_GATE, F.col("brier") < BRIER_GATE), "iou": (WATER_GATE, F.col("iou") >= WATER_GATE)}
    none = (None, F.lit(None).cast("boolean"))
    lines = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(gates.get(n, none)[0]).cast("double").alias("gate"), gates.get(n, none)[1].alias("passed")) for n in means.columns]
    verdict = F.coalesce(F.coalesce(gates["brier"][1], F.lit(True)) & F.coalesce(gates["iou"][1], F.lit(True)) & (F.col("brier").isNotNull() | F.col("iou").isNotNull()), F.lit(False))
    whole = F.struct(F.lit("overall").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("gate"), verdict.alias("passed"))
    return means.select(F.inline(F.array(*lines, whole)))


def leave_one_out(rows: DataFrame, key: str) -> DataFrame:
    """EV-19: for each group, the rows of all others: totals less its own."""
    own = rows.groupBy(key).agg(F.count("*").alias("test"))
    total = own.agg(F.sum("test").alias("all"))
    return own.join(F.broadcast(total), F.lit(True)).select(key, "test", (F.col("all") - F.col("test")).alias("train"))


def seeded_split(id_col: Column, shares: dict[str, float], seed: int) -> Column:
    """EV-19: a part for each id, by its hash; the same id is always in the same part."""
    at = F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string"))), F.lit(1000)) / 1000.0
    out, edge = F.lit(None).cast("string"), 0.0
    cases = []
    for name, share in shares.items():
        edge += share
        cases.append((round(edge, 9), name))
    for edge, name in reversed(cases):
        out = F.when(at < edge, name).otherwise(out)
    return out


def overlap_check(rows: DataFrame, model: Column, rule: Column, bound: float = 0.5) -> DataFrame:
    """GR-33: how two masks agree, and whether they differ so much that a reviewer should know."""
    c = rows.agg(F.count_if(model & rule).alias("overlap"), F.count_if(model).alias("model_cells"), F.count_if(rule).alias("rule_cells"))
    recall, precision = ratio(F.col("overlap"), F.col("rule_cells"), None), ratio(F.col("overlap"), F.col("model_cells"), None)
    one_empty = (F.col("model_cells") == 0) != (F.col("rule_cells") == 0)
    low = F.coalesce(recall < bound, F.lit(False)) | F.coalesce(precision < bound, F.lit(False))
    return c.select("*", recall.alias("rule_recall"), precision.alias("model_precision"), (one_empty | low).alias("material"))


#: Least IoU and precision, share of predictions on ice to stay below, most water of a frozen region; pairs that must pass.
GATE = {"iou": 0.60, "precision": 0.84, "ice": 0.05, "frozen_water": 0.10}
LEAST_PAIRS = 2
#: Probability at the later date and its rise that count as growth by probability.
GROWN = (0.5, 0.2)


def scene_gate(cells: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """EV-07: extent, change and ice share of each pair of scenes at each threshold, and whether the pair passes.

    Cells: pair, season, p0 and p1 (probabilities at both dates), and booleans
    water0, water1 (labels), valid0, valid1, roi, aoi, glacier, vicinity (of
    mapped lakes), steep. One pass over the cells; the thresholds are counted
    side by side. Ratios have four digits and are null where nothing is there.
    """
    c = F.col
    barred = ~c("aoi") | c("steep") | (c("glacier") & ~c("vicinity"))
    region, both = c("roi") & c("valid1"), c("roi") & c("valid0") & c("valid1")
    risen = (c("p1") >= GROWN[0]) & (c("p1") - c("p0") >= GROWN[1]) & both
    labelled = c("water1") & ~c("water0")
    at = []
    for t in thresholds:
        now, then = (c("p1") >= t) & ~barred, (c("p0") >= t) & ~barred
        grown = now & ~then & both
        n = {
            "both": now & c("water1") & region, "either": (now | c("water1")) & region, "predicted": now & region, "found": (c("p1") >= t) & c("water1") & region,
            "expansion": grown, "expansion_tp": grown & labelled, "expansion_fp": grown & ~c("water1"),
            "ice_cells": now & c("glacier") & ~c("vicinity") & c("aoi"), "water_cells": now & c("aoi"),
        }
        at.append(F.struct(F.lit(float(t)).alias("tau"), *[F.count_if(v).alias(k) for k, v in n.items()]))
    fixed = {"region": region, "label": c("water1") & region, "risen": risen, "risen_tp": risen & labelled, "risen_fp": risen & ~c("water1"), "label_change": labelled & both}
    by = cells.groupBy("pair", "season").agg(*[F.count_if(v).alias(k) for k, v in fixed.items()], F.array(*at).alias("_at"))
    by = by.select("pair", "season", *fixed, F.inline("_at"))
    part = lambda a, b: F.round(ratio(c(a), c(b), None), 4)
    by = by.withColumns({"iou": part("both", "either"), "precision": part("both", "predicted"), "recall": part("found", "label"), "ice": part("ice_cells", "water_cells"), "water": part("predicted", "region")})
    dry = ratio(c("predicted"), c("region"), None) <= GATE["frozen_water"]
    extent = (c("iou") >= GATE["iou"]) & (c("precision") >= GATE["precision"])
    passed = F.when(c("season") == "unfrozen", extent).otherwise(dry) & (c("ice") < GATE["ice"])
    return by.drop("both", "either", "found").withColumn("passed", F.coalesce(passed, F.lit(False)))


def scene_verdict(pairs: DataFrame, gates: DataFrame, tau: float) -> DataFrame:
    """EV-07: pairs (pair, in_scope) judged at one threshold; eligible where at least two pairs in scope pass."""
    j = pairs.join(gates.where(F.col("tau") == tau).select("pair", "passed"), "pair")
    n = j.agg(F.count("*").alias("pairs"), F.count_if("in_scope").alias("in_scope"), F.count_if(F.col("in_scope") & F.col("passed")).alias("passed"))
    return n.withColumn("eligible", F.col("passed") >= LEAST_PAIRS)
