"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut with Parquet tables under ``spark.checkpoint.dir``: they survive the
loss of executors, are compressed, and carry sizes that the adaptive planner can use. The
shuffle files of a write are removed with it, since its table takes their place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch for removing an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    mine = getattr(spark, "_runlens_scratch", None)
    if mine is None:
        mine = spark._runlens_scratch = "file://" + tempfile.mkdtemp(prefix="runlens-")
    return mine


class Scratch:
    """Names, writes and drops the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: set[str] = set()

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back: recovery restarts from here."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.add(path)
        out._runlens_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            self._delete(df._runlens_path)

    def only(self, *kept: DataFrame) -> None:
        """Delete every table of this call but ``kept``."""
        for path in {*self.paths} - {df._runlens_path for df in kept}:
            self._delete(path)

    def _delete(self, where: str) -> None:
        self.paths.discard(where)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
