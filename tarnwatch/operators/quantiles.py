"""Exact quantiles of many groups, values and levels at once, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.scratch import Scratch

#: Ranges into which a stretch of values is cut, and how many distinct values of a stretch are sorted at last.
RANGES, FEW = 1024, 4096
#: Stretches that are sent to all tasks; more are joined by a shuffle.
MOST_SENT = 100_000


def grouped_quantiles(rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str], levels: Sequence[float]) -> DataFrame:
    """For each group one array for each value, with its quantile at each level, as ``percentile`` gives it.

    A quantile at level q of n values lies between the values of ranks
    floor((n - 1) q) and ceil((n - 1) q). These are selected by refining
    histograms: the stretch that holds a rank is cut into ranges, counted
    before anything is shuffled, and the range with the rank is the next
    stretch, from its least to its largest value, so that it always shrinks.
    A stretch of few distinct values is sorted. So a group that holds all rows
    takes a few passes over its counts, and none of them is one task's work.

    Nulls and NaN are left out, and infinite values count as the largest
    double. A group without values has null; keys may be null.
    """
    scratch = Scratch(rows.sparkSession, "quantiles")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    most = F.lit(1.7976931348623157e308)

    def clean(v: Column | str) -> Column:
        v = (F.col(v) if isinstance(v, str) else v).cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(-most, F.least(most, v)))

    named = [F.struct(F.lit(n).alias("name"), clean(v).alias("v")) for n, v in values.items()]
    flat = rows.select(key.alias("k"), F.explode(F.array(*named)).alias("x")).select("k", "x.name", "x.v")
    flat = flat.where("v IS NOT NULL")
    counted = scratch.cut(flat.groupBy("k", "name", "v").agg(F.count(F.lit(1)).alias("n")), "counted")

    whole = scratch.cut(counted.groupBy("k", "name").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi")), "whole")
    at = [(F.col("all") - 1) * F.lit(float(q)) for q in levels]
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at])))
    open_ = whole.select("k", "name", F.explode(places).alias("rank"), F.lit(0).cast("long").alias("before"), "distinct", "lo", "hi")
    columns = ["k", "name", "rank", "before", "distinct", "lo", "hi"]
    open_, found = scratch.cut(open_, "open"), None

    def inside(stretches: DataFrame) -> DataFrame:
        s = scratch.cut(stretches.select("k", "name", "lo", "hi", "before").distinct(), "stretches")
        s = F.broadcast(s) if s.count() <= MOST_SENT else s
        return counted.join(s, ["k", "name"]).where(F.col("v").between(F.col("lo"), F.col("hi")))

    while True:
        ready = (F.col("lo") == F.col("hi")) | (F.col("distinct") <= FEW)
        done, rest = open_.where(ready), open_.where(~ready)
        running = Window.partitionBy("k", "name", "lo", "hi").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        seen = inside(done).withColumn("upto", F.col("before") + F.sum("n").over(running))
        mine = seen.select("k", "name", "lo", "hi", "v", "upto", (F.col("upto") - F.col("n")).alias("from"))
        answers = done.join(mine, ["k", "name", "lo", "hi"]).where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto"))).select("k", "name", "rank", "v")
        found = answers if found is None else found.unionByName(answers)
        found = scratch.cut(found, "found")
        if rest.isEmpty():
            break
        # halves, so that no difference overflows
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cut = inside(rest).withColumn("part", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)))
        cut = cut.groupBy("k", "name", "lo", "hi", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("v").alias("l"), F.max("v").alias("h"))
        running = Window.partitionBy("k", "name", "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        cut = cut.withColumn("upto", F.sum("n").over(running))
        met = rest.join(cut, ["k", "name", "lo", "hi"]).withColumn("from", F.col("before") + F.col("upto") - F.col("n"))
        met = met.where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("before") + F.col("upto")))
        open_ = scratch.cut(met.select("k", "name", "rank", F.col("from").alias("before"), F.col("d").alias("distinct"), F.col("l").alias("lo"), F.col("h").alias("hi")).select(*columns), "open")

    ranked = found.groupBy("k", "name").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("v")).join(whole, ["k", "name"])
    each = []
    for p in at:
        low, high = F.element_at("v", F.floor(p)), F.element_at("v", F.ceil(p))
        each.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    wide = ranked.select("k", "name", F.array(*each).alias("q")).groupBy("k").agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in values])
    groups = rows.select(key.alias("k")).distinct()
    told = groups.join(wide, groups["k"].eqNullSafe(wide["k"]), "left").drop(wide["k"])
    return told.select(*[F.col(f"k.{c}").alias(c) for c in keys], *values)


def with_quantiles(aggregated: DataFrame, rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column | str], levels: Sequence[float]) -> DataFrame:
    """A table of one row for each group, with the groups' quantiles attached; keys may be null."""
    q = grouped_quantiles(rows, keys, values, levels)
    if not keys:
        return aggregated.join(F.broadcast(q), F.lit(True), "left")  # one row each
    same = F.lit(True)
    for c in keys:
        q = q.withColumnRenamed(c, f"_q_{c}")
        same = same & aggregated[c].eqNullSafe(F.col(f"_q_{c}"))
    return aggregated.join(q, same, "left").drop(*[f"_q_{c}" for c in keys])


def with_total(rows: DataFrame, key: str) -> DataFrame:
    """Each row once under its key and once under null, told apart by ``_total``: a rollup whose groups can have quantiles attached."""
    own = F.struct(F.col(key).alias("key"), F.lit(False).alias("total"))
    every = F.struct(F.lit(None).cast(rows.schema[key].dataType).alias("key"), F.lit(True).alias("total"))
    return rows.withColumn("_g", F.explode(F.array(own, every))).withColumns({key: F.col("_g.key"), "_total": F.col("_g.total")}).drop("_g")
