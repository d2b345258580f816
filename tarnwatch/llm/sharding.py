"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm import ranking
from tarnwatch.scratch import Scratch


def interleaved_shards(
    df: DataFrame,
    *,
    shards: int = 8,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Deals rows into shards so that each shard has every source's share.

    Rows are shuffled by a seeded key within their source and get the
    fractional rank (rank - offset) / rows of the source, where each source has
    a seeded offset between 0 and 1, so that many sources of one row spread
    over the whole order. All rows are then put in order of that fraction, and
    the order is cut into equal runs. Counts of shards differ by one at most
    (law ``rows``).

    Returns _id, _size (UTF-8 bytes + 1), _crc, _source, shard, slot: slots run
    from 0 without gaps. A null source is a source of its own, a null text
    counts as an empty one, rows that repeat or tie get slots of their own, and
    an empty table gives no rows. Long texts are only measured. Other columns
    are ignored.
    """
    spark = df.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    rows = Scratch(spark, "shards").cut(ranking.keyed(df, id_col, text_col, source_col, size, seed), "keys")
    ranked = ranking.with_source_totals(rows, ranking.before_slice(rows))
    rank = F.row_number().over(ranking.within_slice()) + F.col("_n_before")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_source"))), 1, 7), 16, 10).cast("double")
    ranked = ranked.withColumn("_share", (rank - (drawn + 0.5) / F.lit(float(1 << 28))) / F.col("_n_source"))
    ranked = ranked.withColumn("_cut", F.floor(F.col("_share") * ranking.SLICES).cast("int"))
    ranked = ranked.select("_id", "_size", "_crc", "_source", "_key", "_share", "_cut")
    ranked = Scratch(spark, "shards").cut(ranked, "shares")
    # 4096 totals at most are ordered as a whole
    cuts = ranked.groupBy("_cut").agg(F.count("*").alias("_n"))
    cuts = cuts.select(
        F.col("_cut").alias("_c"),
        F.coalesce(F.sum("_n").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    placed = ranked.join(F.broadcast(cuts), F.col("_cut") == F.col("_c"))
    in_cut = Window.partitionBy("_cut").orderBy("_share", F.col("_source").asc_nulls_last(), "_key", "_id", "_crc", "_size")
    placed = placed.withColumn("_at", F.row_number().over(in_cut) - 1 + F.col("_before"))
    placed = placed.withColumn("shard", F.expr(f"_at * {shards} div _all").cast("int"))
    slot = F.expr(f"_at - (shard * _all + {shards - 1}) div {shards}")
    return placed.select("_id", "_size", "_crc", "_source", "shard", slot.cast("long").alias("slot"))


def attach_shards(df: DataFrame, placed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows themselves with their shard and slot, which replace columns of these names. Each row keeps all else it has."""
    found = ranking.attached(df, placed.select("_id", "_crc", "shard", "slot"), Scratch(df.sparkSession, "shards"), id_col, text_col)
    return found.select(*[F.col("whole").getField(c).alias(c) for c in df.columns if c.lower() not in ("shard", "slot")], "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order."""
    ordered = df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def op1_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interleaved_shards(docs).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 (reflected polynomial 0xEDB88320) of the UTF-8 bytes, by the rule, as DuckDB has no such function.
_CRC_SQL = """
  crc_table AS (
    SELECT list(c ORDER BY i) AS tab FROM (
      SELECT i, list_reduce(list_prepend(i::UBIGINT, [0,1,2,3,4,5,6,7]::UBIGINT[]),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
      FROM range(256) t(i))
  ),
  sized AS (
    SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
      xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(coalesce(text, ''))),
        lambda j: ('0x' || substr(digits, 2 * j + 1, 2))::UBIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc
    FROM (SELECT *, hex(encode(coalesce(text, ''))) AS digits FROM documents), crc_table
  )"""

OP1_SQL = f"""
WITH {_CRC_SQL.strip()},
ranked AS (
  SELECT *, md5('17:' || doc_id) AS k,
    (row_number() OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id)
      - (('0x' || substr(md5(concat_ws(':', '17', source)), 1, 7))::BIGINT::DOUBLE + 0.5::DOUBLE) / 268435456::DOUBLE)
      / count(*) OVER (PARTITION BY source) AS share
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (ORDER BY share, source NULLS LAST, k, doc_id) - 1 AS pos, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (pos * 8 // n)::INT AS shard,
  (pos - ((pos * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""
