"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.scratch import Scratch

#: Minima of up to so many nodes are broadcast (two numbers each); beyond it they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) pairs of ids -> (node, root): the smallest id that each node reaches, itself included.

    Each round hangs every node's larger neighbours below its smallest one,
    and then flattens what hangs there; the number of rounds grows with the
    logarithm of the longest path, and stars end in one. Minima are aggregated
    before they are shuffled. Each round's edges are written to the shared
    folder, and the same pass counts them to see whether anything changed.
    """
    state, name = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))), f"edges-{uuid.uuid4().hex[:8]}"
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = scratch.replace(e, name, *state)
    while before[0]:
        small_enough = 2 * before[0] <= MOST_BROADCAST  # nodes are at most twice the edges
        minima = F.broadcast if small_enough else (lambda x: x)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(minima(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(minima(least), "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        e, now = scratch.replace(small.select("e.u", "e.v").where("u <> v").distinct(), name, *state)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
