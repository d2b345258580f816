"""From raw documents to shards: language, near copies, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of
``documents``, the last one also shard and slot. ``run`` writes each stage's
rows as Parquet and reads them for the next one, so a lost executor costs part
of one stage at most; a stage's input goes when its output is written.

All stages take columns of any name besides doc_id, text, lang and source and
keep them (the last one replaces shard and slot). Ids may be null or repeat:
rows are told apart by id and text. Long texts are taken whole, and an empty
table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.llm import decontaminate, joins, language_id, mixing, near_dedup, sharding
from tarnwatch.scratch import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are in none of the languages: null, wordless, random bytes, or undecided. Rows that repeat share their fate."""
    found = language_id.identify(docs, declared=F.col("lang"), host=F.col("source"))
    return joins.without(docs, found.where("not accepted"), Scratch(spark, "language-stage"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of near copies: five-word shingles, similarity 0.8 or more.

    Wordless texts have no copies and stay. Of rows that repeat id and text one stays; a null id is larger than all others.
    """
    scratch = Scratch(spark, "near-stage")
    found = scratch.cut(near_dedup.near_duplicates(docs, shingle=5, percent=80), "classes")
    kept = joins.without(docs, found.where("not kept"), scratch)
    if found.where("kept").groupBy("_id", "_row").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs; without items all stay."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return joins.without(docs, found.where("n_hit > 0"), Scratch(spark, "benchmark-stage"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources meet their target weights; a null source is one, wordless texts go."""
    return mixing.repeat_rows(docs, mixing.mix_sources(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the mixture into eight shards, each with every source's share; rows that repeat get slots of their own."""
    return sharding.attach_shards(docs, sharding.interleaved_shards(docs))


STAGES = [
    ("language identification", known_language),
    ("near copies", one_of_each),
    ("benchmark decontamination", not_in_benchmark),
    ("source mixture", mixed),
    ("shards", sharded),
]

#: Trigram models and set similarities are beyond SQL; tests/llm holds a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
