"""What filters remove alone, together and in every order: an audit of their interaction.

Failures of a document are gathered as bits. Four filters look at the text
alone; the fifth finds exact copies by an existential self-join: a left-semi
join on the hash, the whole text and a smaller id. Its rows are united with the
failures of the others, and combinations of bits are counted for each part.
Every order of the filters is then a sum over at most 32 counts.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.llm import joins
from tarnwatch.scratch import Scratch

FILTERS = "ABCDE"
_WORD = r"[^\x20\x09-\x0D]+"
#: Copies of one hash that one task of the semi-join takes.
PART_OF_COPIES = 2_000


def _text_failures(text: Column) -> Column:
    """Bits of A (under 200 words), B (under half of the words distinct), C (over 2 % capitals), D (a symbol)."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 200, distinct * 100 < n * 50, capitals.cast("long") * 100 > F.length(text).cast("long") * 2, text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def _later_copies(docs: DataFrame, keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, h1, h2) of rows whose exact text a row with a smaller id has.

    Only texts whose hash occurs twice are read and shuffled again. The right
    side of the semi-join has one row for each such text, its smallest id; the
    left side's copies are spread over as many salts as their number asks for.
    """
    several = keyed.groupBy("h1", "h2").agg(F.sum("n").alias("copies"), F.min("id").alias("least")).where(F.col("copies") > 1)
    several = joins.sized(scratch.cut(several.select("h1", "h2", "copies", "least"), "several"))
    # where the table of copies is too large to broadcast, AQE splits the hot hashes of this join
    copies = docs.select("id", "text", *_hashes(F.col("text"))).join(several, ["h1", "h2"])
    copies = scratch.cut(copies.withColumn("salts", (F.col("copies") / PART_OF_COPIES).cast("int") + 1), "copies")
    later = copies.where(F.col("id") > F.col("least")).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    first = copies.groupBy("h1", "h2", "text").agg(F.min("id").alias("first"), F.max("salts").alias("salts"))
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    first = first.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("text").alias("same"), "first", salts.alias("g_salt"))
    same_hash = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("salt") == F.col("g_salt"))
    is_later = same_hash & (F.col("text") == F.col("same")) & (F.col("first") < F.col("id"))
    return later.join(first, is_later, "left_semi").select("id", "h1", "h2").distinct()


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def failure_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows of each part by combination of failures: part, bits (A is 1, B 2, C 4, D 8, E 16), n, good, toxic.

    ``labels`` has the id, quality and toxic; of labels that repeat an id the
    highest count. A null text is empty; a null id is neither smaller nor
    larger than any id and has no label; rows that repeat an id and a text are
    counted each and share their failures, and none of them marks the other.
    Long texts are taken whole, other columns are ignored, whatever their
    names, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    found = docs.select("id", "part", *_hashes(F.col("text")), _text_failures(F.col("text")).alias("bits"))
    # rows that repeat id, text and part are one row with a count before anything is shuffled
    found = scratch.cut(found.groupBy("id", "part", "h1", "h2").agg(F.max("bits").alias("bits"), F.count(F.lit(1)).alias("n")), "failures")
    copies = _later_copies(docs, found, scratch).select("id", F.lit(None).cast("string").alias("part"), "h1", "h2", F.lit(16).alias("bits"), F.lit(0).cast("long").alias("n"))
    parts = F.filter(F.collect_set(F.struct("part", "n")), lambda x: x["n"] > 0)
    united = found.select(*copies.columns).unionByName(copies).groupBy("id", "h1", "h2").agg(F.bit_or("bits").alias("bits"), parts.alias("parts"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    # an id (or null) that very many rows share is a few rows once its texts are counted
    united = united.select("id", "bits", F.inline("parts")).groupBy("id", "part", "bits").agg(F.sum("n").alias("n")).join(marks, "id", "left")
    counted = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return united.groupBy("part", "bits").agg(F.sum("n").alias("n"), counted("good").alias("good"), counted("toxic").alias("toxic"))


def _total(counts: str, combinations: Column) -> Column:
    return F.aggregate(combinations, F.lit(0).cast("long"), lambda total, i: total + F.element_at(F.col(counts), i + 1))


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from ``failure_counts``.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (all over the part). A combination of k
    failures is removed by each of them in 120 / k of the 120 orders, which
    gives shapley without a second pass. An empty table gives no rows.
    """
    every = range(1 << len(FILTERS))
    slots = lambda c: F.array(*[F.sum(F.when(F.col("bits") == i, F.col(c)).otherwise(F.lit(0))) for i in every])
    wide = counts.groupBy("part").agg(*[slots(c).alias(c) for c in ("n", "good", "toxic")])
    removals = [F.lit(0).cast("long")] * len(FILTERS)
    for i in every[1:]:
        share = 120 // i.bit_count()
        removals = [r + F.element_at("n", i + 1) * share if i >> f & 1 else r for f, r in enumerate(removals)]
    wide = wide.withColumn("removals", F.array(*removals))
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            own, before = 1 << f, sum(1 << g for g in order[:step])
            steps.append(
                {
                    "filter_order": "".join(FILTERS[g] for g in order),
                    "step": step + 1,
                    "f": f,
                    "passing": [i for i in every if not i & (before | own)],
                    "here": [i for i in every if i & own and not i & before],
                    "before": [i for i in every if i & own and i & before],
                }
            )
    # 600 steps, whatever the input
    schema = "array<struct<filter_order: string, step: int, f: int, passing: array<int>, here: array<int>, before: array<int>>>"
    wide = wide.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps)), schema)))
    unique = F.element_at("n", F.call_function("shiftleft", F.lit(1), F.col("s.f")) + 1)
    return wide.select(
        "part",
        F.col("s.filter_order").alias("filter_order"),
        F.col("s.step").alias("step"),
        _total("n", F.col("s.passing")).alias("kept"),
        _total("n", F.col("s.here")).alias("removed"),
        _total("n", F.col("s.before")).alias("redundant"),
        unique.alias("unique_fails"),
        _total("good", F.col("s.here")).alias("good_lost"),
        _total("toxic", F.col("s.here")).alias("toxic_lost"),
        F.element_at("removals", F.col("s.f") + 1).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(failure_counts(docs, labels))


OP12_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), failures AS (
  SELECT t.doc_id, t.part,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
      + 4 * (100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 2 * length(t.text))::INT
      + 8 * regexp_matches(t.text, '[#$%&*|]')::INT + 16 * coalesce(f.first < t.doc_id, false)::INT AS bits
  FROM texts t JOIN firsts f ON f.text = t.text
), marked AS (
  SELECT f.part, f.bits, (l.quality = 1)::INT AS good, (l.toxic = 1)::INT AS toxic
  FROM failures f LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = f.doc_id
), combos AS (
  SELECT part, bits, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM marked GROUP BY part, bits
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT letter AS filter_order FROM letters
  UNION ALL
  SELECT filter_order || letter FROM orders JOIN letters ON NOT contains(filter_order, letter)
), steps AS (
  SELECT o.filter_order, s.step::INT AS step, l.letter, l.bit,
    coalesce((SELECT sum(p.bit) FROM letters p WHERE contains(o.filter_order[1:s.step - 1], p.letter)), 0)::INT AS before
  FROM orders o, (SELECT unnest(range(1, 6)) AS step) s JOIN letters l ON l.letter = o.filter_order[s.step] WHERE length(o.filter_order) = 5
), told AS (
  SELECT c.part, s.filter_order, s.step, s.letter,
    coalesce(sum(c.n) FILTER (c.bits & (s.before | s.bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(c.n) FILTER (c.bits & s.bit > 0 AND c.bits & s.before = 0), 0)::BIGINT AS removed,
    coalesce(sum(c.n) FILTER (c.bits & s.bit > 0 AND c.bits & s.before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(c.n) FILTER (c.bits = s.bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(c.good) FILTER (c.bits & s.bit > 0 AND c.bits & s.before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(c.toxic) FILTER (c.bits & s.bit > 0 AND c.bits & s.before = 0), 0)::BIGINT AS toxic_lost
  FROM combos c, steps s GROUP BY c.part, s.filter_order, s.step, s.letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM told
"""
