"""Session settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "runlens", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and Arrow transfer.

    On a cluster leave ``master`` and ``shuffle_partitions`` to the submit command; adaptive
    execution then sizes shuffles by the data (``coalescePartitions``, ``skewJoin``).
    """
    b = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        b = b.master(master)
        settings["spark.driver.memory"] = "6g"
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
