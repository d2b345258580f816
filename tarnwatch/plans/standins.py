"""Logical tables derived from the given ones, in Spark and as DuckDB SQL.

They carry no real geography; integer arithmetic makes both engines agree.
``SQL[name]`` is a SELECT, and ``with_(names)`` starts a query that uses them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL = {
    "weather": """
      SELECT user_id % 5 AS station, ts::DATE AS day, sum(value::DECIMAL(18,2))::DOUBLE AS precip,
        (sum(value::DECIMAL(18,2))::DOUBLE / count(*)) - 10 AS tmean, min(value) - 10 AS tmin, max(value) - 10 AS tmax, 4000.0::DOUBLE AS station_elev
      FROM events GROUP BY ALL""",
    "climate": """
      SELECT 0::BIGINT AS station, o_orderdate::DATE AS day, (count(*) * 7 % 40)::DOUBLE AS precip, (count(*) % 20)::DOUBLE - 5 AS tmean,
        (count(*) % 20)::DOUBLE - 9 AS tmin, (count(*) % 20)::DOUBLE - 1 AS tmax, 4000.0::DOUBLE AS station_elev
      FROM orders GROUP BY o_orderdate::DATE""",
    "observations": """
      SELECT o_orderkey AS observation_id, o_custkey % 20 AS basin_id, o_orderdate::DATE AS acquired_at, (o_orderkey % 100) / 100.0::DOUBLE AS cloud_fraction,
        (o_orderkey % 7) / 4.0::DOUBLE AS alignment_error, o_totalprice / 100000.0::DOUBLE AS water_area_km2,
        CASE o_orderkey % 3 WHEN 0 THEN 'Sentinel-2 L2A' WHEN 1 THEN 'sentinel-1-grd-nrt' ELSE 'prepared-nrt' END AS source
      FROM orders""",
    "exposures": """
      SELECT l_orderkey AS run_id, l_partkey AS asset_id, l_linenumber AS line,
        CASE l_linenumber % 5 WHEN 0 THEN 'village' WHEN 1 THEN 'bridge' WHEN 2 THEN 'road' WHEN 3 THEN 'well' ELSE 'settlement' END AS asset_type,
        (l_quantity * 10)::BIGINT AS population, (floor(l_extendedprice)::BIGINT % 200)::DOUBLE AS distance_m,
        CASE l_linenumber % 5 WHEN 1 THEN 75.0 WHEN 2 THEN 50.0 ELSE 100.0 END::DOUBLE AS buffer_m, l_returnflag = 'R' AS inundated
      FROM lineitem""",
    "reviews": """
      SELECT event_id AS review_id, user_id AS run_id, CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'reject' ELSE 'defer' END AS decision, ts AS decided_at
      FROM events""",
    "cells": """
      SELECT event_id // 100 AS r, event_id % 100 AS c, value AS a, json_extract_string(props, '$.k')::DOUBLE AS b FROM events""",
    "lakes": """
      SELECT c_custkey AS lake_id, 27 + (c_custkey * 91 % 800) / 100.0::DOUBLE AS lat, 80 + (c_custkey * 37 % 1500) / 100.0::DOUBLE AS lon,
        (c_custkey % 97 + 1) * 1000.0::DOUBLE AS area_m2, 3000 + (c_custkey * 13 % 3000)::DOUBLE AS elev_m FROM customer""",
    "catalogue": """
      SELECT s_suppkey AS event_id, 27 + (s_suppkey * 91 % 800) / 100.0::DOUBLE AS lat, 80 + (s_suppkey * 37 % 1500) / 100.0::DOUBLE AS lon,
        DATE '1996-01-01' + (s_suppkey * 17 % 1800)::INT AS event_date, (s_suppkey % 89 + 1) * 900.0::DOUBLE AS area_m2 FROM supplier""",
    "scores": """
      SELECT doc_id AS sample_id, (doc_id % 5)::INT AS block, quality AS label, (n_chars % 1000) / 1000.0::DOUBLE AS score, DATE '2010-01-01' + (doc_id % 3650)::INT AS event_date
      FROM documents JOIN labels USING (doc_id)""",
    "surveys": """
      SELECT p_partkey AS lake_id, p_type AS lake_type, p_brand AS region, p_size / 10.0::DOUBLE AS area_km2, p_retailprice * 1000.0::DOUBLE AS volume_m3, p_name AS name FROM part""",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def weather(spark, sf_dir) -> DataFrame:
    v = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return (
        table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 5).alias("station"), F.to_date("ts").alias("day"))
        .agg(v.alias("precip"), (v / F.count("*") - 10).alias("tmean"), (F.min("value") - 10).alias("tmin"), (F.max("value") - 10).alias("tmax"))
        .withColumn("station_elev", F.lit(4000.0))
    )


def climate(spark, sf_dir) -> DataFrame:
    n = F.count("*")
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    days = days.agg((n * 7 % 40).cast("double").alias("precip"), *[((n % 20).cast("double") - k).alias(x) for x, k in (("tmean", 5), ("tmin", 9), ("tmax", 1))])
    return days.withColumn("station", F.lit(0).cast("long")).withColumn("station_elev", F.lit(4000.0))


def observations(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("observation_id"),
        (F.col("o_custkey") % 20).alias("basin_id"),
        F.to_date("o_orderdate").alias("acquired_at"),
        ((key % 100) / 100.0).alias("cloud_fraction"),
        ((key % 7) / 4.0).alias("alignment_error"),
        (F.col("o_totalprice") / 100000.0).alias("water_area_km2"),
        F.when(key % 3 == 0, "Sentinel-2 L2A").when(key % 3 == 1, "sentinel-1-grd-nrt").otherwise("prepared-nrt").alias("source"),
    )


def exposures(spark, sf_dir) -> DataFrame:
    kind = F.col("l_linenumber") % 5
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_partkey").alias("asset_id"),
        F.col("l_linenumber").alias("line"),
        F.element_at(F.array(*map(F.lit, ("village", "bridge", "road", "well", "settlement"))), (kind + 1).cast("int")).alias("asset_type"),
        (F.col("l_quantity") * 10).cast("long").alias("population"),
        (F.floor("l_extendedprice") % 200).cast("double").alias("distance_m"),
        F.when(kind == 1, 75.0).when(kind == 2, 50.0).otherwise(100.0).alias("buffer_m"),
        (F.col("l_returnflag") == "R").alias("inundated"),
    )


def reviews(spark, sf_dir) -> DataFrame:
    decision = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "reject").otherwise("defer")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("review_id"), F.col("user_id").alias("run_id"), decision.alias("decision"), F.col("ts").alias("decided_at"))


def cells(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 100).alias("r"), (F.col("event_id") % 100).alias("c"), F.col("value").alias("a"), F.get_json_object("props", "$.k").cast("double").alias("b"))


def shape(spark, sf_dir) -> tuple[int, int]:
    """Rows and columns of the grid."""
    r, c = cells(spark, sf_dir).agg(F.max("r"), F.max("c")).first()
    return r + 1, c + 1


def _place(key):
    return (27 + (key * 91 % 800) / 100.0).alias("lat"), (80 + (key * 37 % 1500) / 100.0).alias("lon")


def lakes(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("lake_id"), *_place(key), ((key % 97 + 1) * 1000.0).alias("area_m2"), (3000 + (key * 13 % 3000)).cast("double").alias("elev_m"))


def catalogue(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    day = F.date_add(F.to_date(F.lit("1996-01-01")), (key * 17 % 1800).cast("int"))
    return table(spark, sf_dir, "supplier").select(key.alias("event_id"), *_place(key), day.alias("event_date"), ((key % 89 + 1) * 900.0).alias("area_m2"))


def scores(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 5).cast("int").alias("block"), F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"),
        F.date_add(F.to_date(F.lit("2010-01-01")), (F.col("doc_id") % 3650).cast("int")).alias("event_date"),
    )


def surveys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("lake_id"), F.col("p_type").alias("lake_type"), F.col("p_brand").alias("region"), (F.col("p_size") / 10.0).alias("area_km2"), (F.col("p_retailprice") * 1000.0).alias("volume_m3"), F.col("p_name").alias("name")
    )
