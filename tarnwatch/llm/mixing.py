"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm import ranking
from tarnwatch.scratch import Scratch


def water_fill(sources: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Target words for each source: (_source, _words_source) -> + target.

    Sources in code-point order, null last, take the weights in turn. The
    budget is ``share`` of all words. A source whose proportional part is above
    ``max_epochs`` times its words is clamped there and the excess is shared
    among the others by weight, again until none is above. Clamping runs in
    order of words per weight, so prefix sums over the sources give the point
    at which it ends. There is one short row for each source here, and their
    order is one task's work: some million sources are fine, a source for each
    document is not.
    """
    in_order = Window.orderBy(F.col("_source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    table = sources.withColumn("_w", F.element_at(kinds, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    table = table.withColumn("_cap", F.col("_words_source") * F.lit(float(max_epochs)))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumns(
        {
            "_clamped": F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_open_w": F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing)),
            "_budget": F.sum("_words_source").over(every) * F.lit(float(share)),
        }
    )
    # the level if all sources before this one are clamped; the first that fits under its cap ends the filling
    table = table.withColumn("_level", (F.col("_budget") - F.col("_clamped")) / F.col("_open_w"))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    table = table.withColumn("_level", F.first(fits, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap"))
    return table.select("_source", "_words_source", target.alias("target"))


def mix_sources(
    df: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 23,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each row is repeated so that sources meet their targets.

    Every row gets the whole repetitions of its source's rate. What is left of
    the target is filled in seeded order: one more repetition of each row until
    the target is met, the row that meets it in part only. So a source's taken
    words differ from its target by less than one, one row of a source at most
    has a broken repetition, and no row is taken more than ``max_epochs`` times.

    Returns _id, _crc, _size (words), _source, _words_source, target, taken
    (words). A null text has no words, a null source is a source of its own
    (the last), repeated rows count each by itself, and an empty table gives no
    rows. Long texts are only counted. Other columns are ignored.
    """
    spark = df.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(ranking.WORD)), F.lit(0))
    rows = Scratch(spark, "mix").cut(ranking.keyed(df, id_col, text_col, source_col, size, seed), "keys")
    slices = ranking.before_slice(rows)
    targets = water_fill(rows.groupBy("_source").agg(F.sum("_size").alias("_words_source")), weights=weights, share=share, max_epochs=max_epochs)
    targets = targets.select(F.col("_source").alias("_t"), "target")
    # the targets reach the rows through the slices, so that no join has a source as its only key
    slices = slices.join(targets, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    taken = ranking.with_source_totals(rows, slices)
    rate = F.when(F.col("_words_source") > 0, F.col("target") / F.col("_words_source")).otherwise(F.lit(0.0))
    running = F.sum("_size").over(ranking.within_slice().rowsBetween(Window.unboundedPreceding, 0)) + F.col("_words_before")
    taken = taken.withColumns({"_whole": F.floor(rate), "_running": running})
    taken = taken.withColumn("_need", F.col("target") - F.col("_whole") * F.col("_words_source"))
    before = F.col("_running") - F.col("_size")
    more = F.greatest(F.lit(0), F.least(F.col("_size"), F.floor("_need") - before))
    words = (F.col("_whole") * F.col("_size") + more).cast("long")
    return taken.select("_id", "_crc", "_size", "_source", "_words_source", "target", words.alias("taken"))


def repeat_rows(df: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows themselves, each as often as the mix takes it: whole texts, so a broken repetition is rounded.

    Rows without words are never taken. Columns of any name are kept.
    """
    times = mixed.where("_size > 0").select("_id", "_crc", F.round(F.col("taken") / F.col("_size")).cast("int").alias("repeats")).where("repeats > 0")
    found = ranking.attached(df, times, Scratch(df.sparkSession, "mix"), id_col, text_col)
    return found.select("whole", F.explode(F.sequence(F.lit(1), "repeats"))).select("whole.*")


def op6_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_words_source").alias("source_size"),
        "target",
        "taken",
    )


OP6_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5('23:' || doc_id) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS words FROM sized GROUP BY source
), weighted AS (
  SELECT source, words, 2.0::DOUBLE * words AS cap,
    list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w,
    1.5::DOUBLE * sum(words) OVER () AS budget
  FROM sources
), leveled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, cap / w AS fill
  FROM weighted WINDOW f AS (ORDER BY cap / w, source NULLS LAST)
), lev AS (
  SELECT arg_min(level, (fill, coalesce(source, chr(1114111)))) AS level FROM leveled WHERE level * w <= cap
), targets AS (
  SELECT source, words, coalesce(least(cap, (SELECT level FROM lev) * w), cap) AS target FROM weighted
), running AS (
  SELECT s.*, t.words, t.target, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, words AS source_size, target,
  (size * whole + greatest(0, least(size, floor(target - whole * words) - (cum - size))))::BIGINT AS taken
FROM running
"""
