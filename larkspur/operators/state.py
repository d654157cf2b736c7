"""Snapshots and runs kept as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_snapshot(snapshots: DataFrame, source_type: str, identity: str) -> DataFrame:
    """The newest snapshot of the identity, or else the newest without one."""
    own = snapshots.where((F.col("source_type") == source_type) & F.col("source_identity").isin(identity, ""))
    return own.orderBy(F.desc(F.col("source_identity") == identity), F.desc("captured_at"), F.desc("id")).limit(1)


def list_snapshots(snapshots: DataFrame, limit: int = 0) -> DataFrame:
    """The newest snapshots; 50 unless a limit is given."""
    return snapshots.orderBy(F.desc("captured_at"), F.desc("id")).limit(limit if limit > 0 else 50)


def current_runs(log: DataFrame) -> DataFrame:
    """The last state of each run, of a log of its states."""
    facts = [c for c in log.columns if c != "run_id"]
    return log.groupBy("run_id").agg(F.max_by(F.struct(*facts), F.struct("at", "seq")).alias("last")).select("run_id", "last.*")


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("at"), F.desc("run_id")).limit(limit)


def reconciled(runs: DataFrame, before, error: str = "stale run") -> DataFrame:
    """Runs that still run although they began before a time are failed; an error that they have stays."""
    stale = (F.col("status") == "running") & (F.col("at") < before)
    message = F.when(F.coalesce(F.col("error"), F.lit("")) == "", error).otherwise(F.col("error"))
    return runs.withColumns({"error": F.when(stale, message).otherwise(F.col("error")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def config_hash(config: Column) -> Column:
    """The first eight bytes of a configuration's SHA-256, by which a resumed run knows it again."""
    return F.substring(F.sha2(config, 256), 1, 16)


def created(runs: DataFrame) -> DataFrame:
    """Events that create runs (run_id, at, kind, config): a run without kind applies."""
    kind = F.when(F.trim(F.coalesce("kind", F.lit(""))) == "", "apply").otherwise(F.col("kind"))
    return _events(runs, "create", kind=kind, config_hash=config_hash(F.coalesce("config", F.lit("null"))), status=F.lit("running"))


def entered(phases: DataFrame) -> DataFrame:
    """Events of runs (run_id, at, phase) that enter a phase."""
    return _events(phases, "phase", phase=F.col("phase"))


def completed(ends: DataFrame) -> DataFrame:
    """Events that end runs (run_id, at, status, error)."""
    return _events(ends, "complete", status=F.col("status"), error=F.col("error"))


EVENT = {"run_id": None, "event": None, "at": None, "kind": "string", "config_hash": "string", "phase": "string", "status": "string", "error": "string"}


def _events(df: DataFrame, event: str, **facts: Column) -> DataFrame:
    rest = [facts.get(c, F.lit(None)).cast(t).alias(c) for c, t in EVENT.items() if t]
    return df.select("run_id", F.lit(event).alias("event"), "at", *rest)


def fresh(events: DataFrame, log: DataFrame) -> DataFrame:
    """The events that the log doesn't have: what was written once is not written again, however often it is tried."""
    same = [events[c].eqNullSafe(log[c]) for c in EVENT]
    return events.dropDuplicates().join(log, same, "left_anti")


def runs_of(log: DataFrame) -> DataFrame:
    """Each run as its events tell: when it began and with what, its last phase, how and when it ended.

    The last event of a kind counts; of events of one time the one that ends the run.
    """
    rank = F.when(F.col("event") == "complete", 2).when(F.col("event") == "phase", 1).otherwise(0)
    last = lambda c, *events: F.max_by(F.when(F.col("event").isin(*events), F.col(c)), F.when(F.col("event").isin(*events), F.struct("at", rank, F.coalesce("phase", "status", F.lit("")))))
    return log.groupBy("run_id").agg(
        F.min(F.when(F.col("event") == "create", F.col("at"))).alias("started_at"), last("kind", "create").alias("kind"), last("config_hash", "create").alias("config_hash"), last("phase", "phase").alias("phase"),
        F.coalesce(last("status", "create", "complete"), F.lit("running")).alias("status"), F.max(F.when(F.col("event") == "complete", F.col("at"))).alias("completed_at"), last("error", "complete").alias("error"),
    )


def run(runs: DataFrame, run_id) -> DataFrame:
    """The run of an id."""
    return runs.where(F.col("run_id") == run_id)
