"""Run bookkeeping: selection, resumption, statuses, limits, attempts, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import shorten


def select_instances(rows: DataFrame, key: str = "instance_id", ids: DataFrame | None = None, pattern: str | None = None, slice_spec: str = "", shuffle: bool = False) -> DataFrame:
    """An id list or else a pattern anchored at the start, then a slice start:stop:step of the ordered rows.

    Order is by id, or by a seeded hash of it with ``shuffle`` (no engine can repeat another's shuffle).
    """
    if ids is not None:
        rows = rows.join(ids.select(F.trim(F.col("value")).alias(key)).filter(f"{key} <> ''").distinct(), key, "left_semi")
    elif pattern:
        rows = rows.filter(F.col(key).cast("string").rlike(f"^(?:{pattern})"))
    if not slice_spec and not shuffle:
        return rows
    order = [F.xxhash64(F.col(key), F.lit(42)), F.col(key)] if shuffle else [F.col(key)]
    ranked = rows.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1)  # ids of one selection
    if slice_spec:
        start, stop, step = (int(x) if x else None for x in [*slice_spec.split(":"), "", ""][:3])
        wanted = range(*slice(start, stop, step).indices(rows.count()))
        low, high = (min(wanted), max(wanted)) if wanted else (0, -1)
        ranked = ranked.filter(F.col("_i").between(low, high) & (F.pmod(F.col("_i") - low, F.lit(abs(wanted.step))) == 0))
    return ranked.drop("_i")


def containing(rows: DataFrame, part: str, key: str = "instance_id") -> DataFrame:
    """Rows whose id holds ``part``; an empty one keeps all."""
    return rows.filter(F.col(key).contains(part)) if part else rows


def not_done(rows: DataFrame, done: DataFrame, key: str = "instance_id") -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, log: DataFrame, key: str, order: str, value: str = "value") -> DataFrame:
    """The last row per key of a base and a log of changes, with the base's columns; a null ``value`` in the last change deletes."""
    last = base.unionByName(log).groupBy(key).agg(F.max_by(F.struct(*(c for c in base.columns if c != key)), order).alias("r"))
    return last.select(key, "r.*").filter(F.col(value).isNotNull()).select(*base.columns)


#: Newest ids kept per status: however short, they fill the text shown.
SHOWN = 60


def status_report(rows: DataFrame, status: str, key: str, arrival: str, most: int = 55) -> DataFrame:
    """Rows per status and the newest ids as one text of ``most`` characters, shortened with dots or padded."""
    shown = max(SHOWN, most)
    text = F.col(key).cast("string")
    newest = Window.partitionBy(status).orderBy(F.col(arrival).desc(), text.desc())
    top = rows.select(status, text.alias("k"), F.row_number().over(newest).alias("i")).filter(F.col("i") <= shown)
    listed = top.groupBy(status).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "k"))), lambda x: x["k"]), ", ").alias("l"))
    counts = rows.groupBy(status).agg(F.count("*").alias("n"))
    return counts.join(listed, counts[status].eqNullSafe(listed[status])).select(counts[status], "n", shorten(F.col("l"), most).alias("latest"))


def run_summary(rows: DataFrame, ok: Column) -> DataFrame:
    total, good = F.count("*"), F.count_if(ok)
    return rows.agg(total.alias("total"), good.alias("successful"), (total - good).alias("failed"), F.coalesce(F.try_divide(good, total), F.lit(0.0)).alias("success_rate"))


def calls_before_limit(calls: DataFrame, by: str, order: list[str], cost: str, step_limit: int = 0, cost_limit: float = 3.0) -> DataFrame:
    """Calls that may start: fewer than ``step_limit`` before and less than ``cost_limit`` spent; 0 is no limit."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = calls.withColumn("n_before", F.count("*").over(w)).withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0.0)))
    ok = F.lit(True)
    if step_limit > 0:
        ok = ok & (F.col("n_before") < step_limit)
    if cost_limit > 0:
        ok = ok & (F.col("spent_before") < cost_limit)
    return seen.filter(ok)


def interleave(calls: DataFrame, by: str, order: str, sequence: list[str]) -> DataFrame:
    """Round-robin choice per log."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return calls.withColumn("model", F.get(F.array(*map(F.lit, sequence)), F.pmod(n, F.lit(len(sequence)))))


def first_valid(attempts: DataFrame, by: list[str], order: list[str], ok: Column, value: str, most: int = 3) -> DataFrame:
    """Per group the first valid one of the first ``most`` attempts, and how many were made until then."""
    w = Window.partitionBy(*by).orderBy(*order)
    made = attempts.withColumn("attempt", F.row_number().over(w)).filter(F.col("attempt") <= most).withColumn("ok", ok)
    return made.groupBy(*by).agg(F.min_by(F.when(F.col("ok"), F.col(value)), F.when(F.col("ok"), F.col("attempt"))).alias("value"), F.coalesce(F.min(F.when(F.col("ok"), F.col("attempt"))), F.max("attempt")).alias("attempts"))


def resolved(rows: DataFrame) -> Column:
    """Evaluation, then the run's own verification, then its success flag, then a judge."""
    return F.coalesce("eval_resolved", "all_passed", "agent_success", "judge_resolved")
