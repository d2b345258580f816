"""Exact ranks and running sums over a seeded shuffle, without one task per source.

Each row gets a shuffle key (md5 of a seed and the row's id, or of its text's
CRC where the id is null), whose first digits name one of 4096 slices. Ranks within a slice plus the totals of the slices
before it give ranks within the source: a source with a third of all rows is
spread over 4096 groups, and only slice totals are ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.joins import packed, sized
from tarnwatch.scratch import Scratch

#: Slices of a source; three hexadecimal digits of the shuffle key.
SLICES = 4096
WORD = r"[^ \t-\r]+"  # what stands between spaces and \x09-\x0D


def crc(text: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, size: Column, seed: int) -> DataFrame:
    """(_id, _source, _size, _crc, _key, _slice) for each row; never the text itself."""
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        size.cast("long").alias("_size"),
        crc(text_col).cast("long").alias("_crc"),
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.col("_crc").cast("string"))))
    return rows.withColumn("_key", key).withColumn("_slice", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))


def before_slice(rows: DataFrame) -> DataFrame:
    """For each (source, slice): rows and words of the source's earlier slices, and the source's totals."""
    slices = rows.groupBy("_source", "_slice").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"))
    whole = Window.partitionBy("_source")
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select(
        F.col("_source").alias("_s"),
        F.col("_slice").alias("_b"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_words_before"),
        F.sum("_n").over(whole).alias("_n_source"),
        F.sum("_words").over(whole).alias("_words_source"),
    )


def within_slice() -> Window:
    return Window.partitionBy("_source", "_slice").orderBy("_key", "_id", "_crc", "_size")


def with_source_totals(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Joins rows to a table keyed by (_s, _b); no hot key, as each source is cut into slices."""
    same = rows["_source"].eqNullSafe(table["_s"]) & (rows["_slice"] == table["_b"])
    return rows.join(table, same).drop("_s", "_b")


def _copies(rows: DataFrame) -> DataFrame:
    """Numbers the rows of equal (key, check) from 1, in order of part and place.

    Counts of the parts before a row's own come from one row for each part, so
    that no task sees more of a hot key than one part of the table.
    """
    of_key = Window.partitionBy("key", "check").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("key", "check", "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(of_key), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy("key", "check", "part").orderBy("place"))
    return rows.join(parts, ["key", "check", "part"]).withColumn("copy", here + F.col("before")).drop("part", "before")


def attached(df: DataFrame, decisions: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(whole, decision columns): rows as one struct each, joined with decisions keyed by (_id, _crc).

    Rows that repeat an id and text take the decisions of their copies one
    each. Then the rows are written once with their place, and only places are
    numbered and matched; no text is shuffled if the matches can be broadcast.
    """
    place = [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")]
    told = F.struct(*[c for c in decisions.columns if c not in ("_id", "_crc")]).alias("told")
    decisions = scratch.cut(decisions.select("_id", "_crc", told, *place), "decisions")
    own = packed(df, id_col, crc(text_col).cast("long"))
    if decisions.groupBy("_id", "_crc").count().where("count > 1").isEmpty():
        same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_hash") == F.col("_crc"))
        return own.join(sized(decisions.select("_id", "_crc", "told.*")), same).drop("own_id", "own_hash", "_id", "_crc")
    name = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("key")
    own = scratch.cut(own.select("whole", name("own_id"), F.col("own_hash").alias("check"), *place), "rows")
    told = _copies(decisions.select(name("_id"), F.col("_crc").alias("check"), "told", "part", "place")).drop("place")
    met = _copies(own.select("key", "check", "part", "place")).join(told, ["key", "check", "copy"])
    met = sized(scratch.cut(met.select("place", "told.*"), "met"))
    return own.select("whole", "place").join(met, "place").drop("place")
