"""Written tables that cut a long lineage.

The tables go below the folder that ``spark.checkpoint.dir`` names, which the
driver and all executors share, so that they outlive any executor. Only in
local mode, where there is one machine, may the setting be missing: then a
temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_BATCH, _DEFAULT, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a folder of one machine only where Spark runs on one machine."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tarnwatch-", dir="/tmp")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


class Scratch:
    """Tables of one job. ``cut`` writes a frame once and reads it back."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:  # rows hold whole texts: Python tasks take them in smaller batches
            spark.conf.set(_BATCH, _ROWS)
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self._last: dict[str, str] = {}
        self._made = 0

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self._made += 1
        path = f"{self.root}/{name}-{self._made}"
        df.write.parquet(path)
        self._last[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame, name: str, *measures) -> tuple[DataFrame, tuple]:
        """Cuts a frame, deletes the table last cut under the name (which ``df`` may read), and gives the measures taken while writing."""
        before, seen = self._last.get(name), Observation()
        taken = {f"m{i}": m for i, m in enumerate(measures or (F.count(F.lit(1)),))}
        table = self.cut(df.observe(seen, *[m.alias(k) for k, m in taken.items()]), name)
        values = tuple(seen.get.get(k) for k in taken)
        if before:
            self._delete(before)
        return table, values

    def drop(self, name: str) -> None:
        """Deletes the last table cut under the name, when nothing reads it any more."""
        path = self._last.pop(name, None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Deletes all tables of the job, when nothing reads them any more."""
        self._last.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
