"""Streaming forms: once-only injection, running status counts, keyed upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.ids import file_of


def candidates(mentions: DataFrame, items: DataFrame, selected: DataFrame) -> DataFrame:
    """Stream of (run_id, pos, api_path) that may fire; the skill tables are the static side."""
    paths = items.join(selected.select("source_instance_id").distinct(), "source_instance_id", "left_semi").select("api_path", file_of(F.col("api_path")).alias("filepath")).distinct()
    return mentions.join(paths, "filepath").select("run_id", "pos", "api_path")


def inject_once(hits: DataFrame) -> DataFrame:
    """Each api path once per run, in append mode; state is the paths a run has used, dropped at its end.

    A hit with a null api_path marks the end of a run.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = set(state.get[0]) if state.exists else set()
        out, over = [], False
        rows = pd.concat(list(batches)).sort_values("pos", kind="stable")
        for pos, path in zip(rows["pos"], rows["api_path"], strict=True):
            if path is None:
                over = True
            elif path not in used:
                used.add(path)
                out.append((key[0], int(pos), path))
        if over and state.exists:
            state.remove()
        elif not over:
            state.update((sorted(used),))
        yield pd.DataFrame(out, columns=["run_id", "pos", "api_path"])

    return hits.groupBy("run_id").applyInPandasWithState(step, "run_id bigint, pos bigint, api_path string", "used array<string>", "append", GroupStateTimeout.NoTimeout)


def first_seen(hits: DataFrame) -> DataFrame:
    """The weaker JVM-side form: drop repeats by (run_id, api_path), whichever row comes first."""
    return hits.dropDuplicates(["run_id", "api_path"])


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """Running counts for complete mode."""
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def upsert_sink(path: str, key: str, order: str):
    """A foreachBatch function that keeps the last row per key in versioned tables <path>/v<batch>."""
    from runlens.operators.runs import upsert

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(f"{path}/v{batch_id - 1}") if batch_id else batch.limit(0)
        upsert(base, batch, key, order).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write
