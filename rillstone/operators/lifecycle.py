"""Rules of membership, attempts, retry, replicas and history over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Failure kinds that may run again, attempts at most, and seconds that a phase may take.
RETRYABLE = ("INPUT_UNAVAILABLE", "ENVIRONMENT_MISMATCH", "EXECUTION_ERROR")
MOST_ATTEMPTS = 2
DEADLINES = {"prepare": 60, "context": 30, "dispatch": 30, "transfer": 60, "cancel": 30}


def heartbeat_verdicts(beats: DataFrame) -> DataFrame:
    """Adds verdict to heartbeats (worker, at, seq, ...) in order of arrival: applied, or duplicate or stale against the highest before."""
    w = W.partitionBy("worker").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1)
    high = F.max("seq").over(w)
    return beats.withColumn("verdict", F.when(F.col("seq") < high, "stale").when(F.col("seq") == high, "duplicate").otherwise("applied"))


def generations(registrations: DataFrame) -> DataFrame:
    """Adds generation (1, 2, ...) and active, true for a worker's last registration."""
    w = W.partitionBy("worker").orderBy("at", "id")
    return registrations.withColumn("generation", F.row_number().over(w).cast("long")).withColumn("active", F.lead("id").over(w).isNull())


def silent_gaps(beats: DataFrame, timeout_seconds: int) -> DataFrame:
    """Heartbeats that came more than the timeout after the one before: (worker, id, gap_seconds)."""
    w = W.partitionBy("worker").orderBy("at", "id")
    gap = F.timestamp_diff("SECOND", F.lag("at").over(w), F.col("at"))
    return beats.withColumn("gap_seconds", gap).filter(F.col("gap_seconds") > timeout_seconds).select("worker", "id", "gap_seconds")


def overdue(operations: DataFrame, now: Column) -> DataFrame:
    """Operations (phase, started, bytes) past their phase's deadline; a transfer has a second more for each MiB."""
    limit = F.lit(None).cast("long")
    for phase, seconds in DEADLINES.items():
        limit = F.when(F.col("phase") == phase, F.lit(seconds)).otherwise(limit)
    limit = limit + F.when(F.col("phase") == "transfer", F.floor(F.coalesce(F.col("bytes"), F.lit(0)) / (1 << 20))).otherwise(0)
    return operations.filter(now - F.col("started") > limit)


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """Adds outcome to success reports (task, at, id, generation, current): stale if from an old generation, else committed for the first, duplicate after."""
    fits = F.col("generation") == F.col("current")
    w = W.partitionBy("task", fits).orderBy("at", "id")
    return attempts.withColumn("outcome", F.when(~fits, "stale").when(F.row_number().over(w) == 1, "committed").otherwise("duplicate"))


def commit_violations(attempts: DataFrame) -> DataFrame:
    """(task, commits) of the tasks committed more than once."""
    return attempts.filter("outcome = 'committed'").groupBy("task").agg(F.count("*").alias("commits")).filter("commits > 1")


def retry_decisions(failures: DataFrame) -> DataFrame:
    """Adds decision to failures (task, attempt, kind, native): retry or fail."""
    again = F.col("kind").isin(*RETRYABLE) & (F.col("attempt") < MOST_ATTEMPTS) & ~F.col("native")
    return failures.withColumn("decision", F.when(again, "retry").otherwise("fail"))


def loss_decisions(losses: DataFrame) -> DataFrame:
    """What a lost worker does to its runs, first rule first: (.., outcome)."""
    return losses.withColumn(
        "outcome",
        F.when(F.col("native_in_flight") | F.col("shared_in_flight"), "NATIVE_STATE_UNCERTAIN").when(F.col("context_needed"), "CONTEXT_LOST").when(F.col("affinity_impossible"), "PLACEMENT_CONSTRAINT_LOST").when(F.col("data_gone"), "DATA_LOST").otherwise("replay"),
    )


def latest_replicas(events: DataFrame) -> DataFrame:
    """Of announcements and withdrawals (value, worker, seq, kind): the replicas whose last event is an announcement."""
    last = events.groupBy("value", "worker").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
    return last.filter("kind = 'available'").select("value", "worker", "seq")


def releasable(uses: DataFrame, runs: DataFrame) -> DataFrame:
    """(value) of the values that only runs in a final state use."""
    final = runs.select("run", F.col("status").isin("succeeded", "failed", "cancelled").alias("final"))
    return uses.join(final, "run", "left").groupBy("value").agg(F.min(F.coalesce("final", F.lit(False)).cast("int")).alias("all_final")).filter("all_final = 1").select("value")


def run_status(runs: DataFrame, attempts: DataFrame, most: int = 1024) -> DataFrame:
    """Per run and task, the last attempt; a run shows its first `most` tasks, with its number of tasks and whether it shows all."""
    last = attempts.groupBy("run", "task").agg(F.max_by(F.struct("attempt", "status"), "attempt").alias("last"), F.count("*").alias("attempts"))
    per = last.groupBy("run").agg(F.count("*").alias("task_count"))
    shown = last.withColumn("n", F.row_number().over(W.partitionBy("run").orderBy("task"))).filter(F.col("n") <= most)
    out = shown.join(per, "run").join(runs.select("run", "run_status"), "run")
    return out.select("run", "run_status", "task", F.col("last.attempt").alias("attempt"), F.col("last.status").alias("status"), "attempts", "task_count", (F.col("task_count") > most).alias("truncated"))


def state_violations(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """(rule, subject): attempts of no run, finished runs with running attempts, attempt numbers with holes."""
    orphan = attempts.join(runs, "run", "left_anti").select(F.lit("orphan_attempt").alias("rule"), F.col("run").alias("subject")).distinct()
    running = attempts.filter("status = 'running'").join(runs.filter("run_status <> 'running'"), "run").select(F.lit("running_in_finished_run"), "run").distinct()
    holes = attempts.groupBy("run", "task").agg(F.max("attempt").alias("m"), F.count_distinct("attempt").alias("n")).filter("m <> n").select(F.lit("attempt_hole"), "run").distinct()
    return orphan.union(running).union(holes)


def loads(attempts: DataFrame) -> DataFrame:
    """Running and reserved slots of each worker."""
    return attempts.groupBy("worker").agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "reserved").alias("reserved"))


def capacity_counts(attempts: DataFrame) -> DataFrame:
    """Active attempts by run, by worker and overall, in one pass: (run, worker, active), null where summed over."""
    active = attempts.filter("status IN ('running', 'reserved')").select("run", "worker")
    return active.groupingSets([[F.col("run")], [F.col("worker")], []], F.col("run"), F.col("worker")).agg(F.count("*").alias("active"))
