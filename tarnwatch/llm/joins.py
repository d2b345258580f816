"""Joins of rows to a table of groups, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.scratch import Scratch

#: A table of groups of at most so many rows is broadcast; a larger one is salted.
MOST_BROADCAST = 50_000
SALTS = 64


def every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))


def with_groups(rows: DataFrame, groups: DataFrame, key: str, by: str, scratch: Scratch) -> DataFrame:
    """Left join on ``key`` (null-safe is the caller's matter). ``by`` spreads the rows of a key over salts."""
    groups = scratch.cut(groups, "groups")
    if groups.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(groups), key, "left")
    salted = groups.withColumn("_salt", every_salt())
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).join(salted, [key, "_salt"], "left").drop("_salt")


#: Bytes that a broadcast may take in memory: for each row 40, and 8 for each number or 48 for each string.
MOST_BYTES = 64 << 20


def sized(table: DataFrame) -> DataFrame:
    """The table, marked for a broadcast if it is small enough. It should be a written one, as it is counted."""
    each = 40 + sum(48 if f.dataType.typeName() in ("string", "binary", "array", "struct") else 8 for f in table.schema)
    return F.broadcast(table) if table.count() * each <= MOST_BYTES else table


def packed(df: DataFrame, id_col: str, hashed: Column) -> DataFrame:
    """(whole, own_id, own_hash): the row as one struct, so that no column of its can clash with inner ones."""
    return df.select(F.struct("*").alias("whole"), F.col(id_col).alias("own_id"), hashed.alias("own_hash"))


def without(rows: DataFrame, rejected: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows but those whose (_id, hash of the text) is in ``rejected`` as (_id, _row); ids may be null or repeat."""
    gone = sized(scratch.cut(rejected.select("_id", "_row").distinct(), "rejected"))
    own = packed(rows, id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_hash") == F.col("_row"))
    return own.join(gone, same, "left_anti").select("whole.*")
