"""Incremental jobs over landed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Columns of the ledger.
LEDGER = "source string, scene_id string, taken timestamp, href string"


def new_scenes(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """SM-01: scenes of a batch that have an id and are not in the ledger, one row for each (source, scene_id)."""
    once = batch.where(F.col("scene_id").isNotNull()).groupBy("source", "scene_id").agg(F.min("taken").alias("taken"), F.min_by("href", "taken").alias("href"))
    return once.join(ledger.select("source", "scene_id"), ["source", "scene_id"], "left_anti")


def register_scenes(stream: DataFrame, ledger_path: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """SM-01: appends unseen scenes to a Parquet ledger.

    Repeats within the delay are dropped in state; the anti-join with the
    ledger keeps the job idempotent beyond it, also when a batch runs again.
    """

    def first_time(spark) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        return not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if first_time(spark):
            spark.createDataFrame([], LEDGER).write.parquet(ledger_path)
        new_scenes(batch, spark.read.schema(LEDGER).parquet(ledger_path)).write.mode("append").parquet(ledger_path)

    once = stream.withWatermark("taken", delay).dropDuplicatesWithinWatermark(["source", "scene_id"])
    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """SM-03: new observations scored with the batch expressions and appended."""
    return score(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(events: DataFrame) -> DataFrame:
    """SM-02: the state of each job from its transitions (job_id, seq, status, error, path).

    Status and error are those of the last transition, so one without an error
    clears it; the path is the last that was given; each transition is an attempt.
    """
    return events.groupBy("job_id").agg(
        F.max_by("status", "seq").alias("status"), F.count("*").alias("attempts"), F.max_by("error", "seq").alias("last_error"), F.max_by("path", F.when(F.col("path").isNotNull(), F.col("seq"))).alias("path")
    )


def job_state_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """SM-02: keeps the states of all jobs in a streaming aggregation.

    Each batch writes the jobs that it changed as a version of their own, which
    a batch that runs again replaces. Transitions may come in any order.
    """

    def changed(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={n}")

    return job_states(stream).writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each job's state."""
    rows = spark.read.parquet(path)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in ("job_id", "version")]), "version")
    return rows.groupBy("job_id").agg(newest.alias("job")).select("job_id", "job.*")
