"""The catalogue of projects and jobs: views, states, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIVE, FAILED = ("queued", "running", "cancelling"), ("failed", "RECONSTRUCTION_BLOCKED")


def with_counts(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unarchived projects with their number of missions, 0 included; one aggregate and one join."""
    n = jobs.groupBy(F.col("project_id").alias("_p")).agg(F.count("*").alias("mission_count"))
    return projects.where("archived_at IS NULL").join(n, F.col("id") == F.col("_p"), "left").drop("_p").fillna({"mission_count": 0})


def kpis(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.agg(F.count("*").alias("total"), F.count_if(s.isin(*ACTIVE)).alias("active"), F.count_if(s == "completed").alias("completed"), F.count_if(s.isin(*FAILED)).alias("failed"))


def latest(jobs: DataFrame, n: int = 100) -> DataFrame:
    """Newest jobs first; the id settles ties."""
    return jobs.orderBy(F.col("created").desc(), F.col("id").desc()).limit(n)


def prune_failed(jobs: DataFrame, keep: int, protected: list) -> DataFrame:
    """Without failed jobs beyond the newest ``keep``, unless they are protected. Failed jobs are numbered without one big window: the cut-off row is found by a top-k."""
    failed = jobs.where("status = 'failed'").select(F.col("created").alias("_c"), F.col("id").alias("_i"))
    edge = failed.orderBy(F.col("_c").desc(), F.col("_i").desc()).limit(keep).agg(F.min(F.struct("_c", "_i")).alias("_edge"), F.count("*").alias("_n"))
    old = (F.col("status") == "failed") & (F.col("_n") == keep) & (F.struct("created", "id") < F.col("_edge"))
    return jobs.crossJoin(F.broadcast(edge)).where(~F.coalesce(old, F.lit(False)) | F.col("id").isin(*protected)).drop("_edge", "_n")


def current_state(events: DataFrame, by: str, time: Column, seq: str, status: str) -> DataFrame:
    """Latest status of each job; later rows win, the sequence settles ties."""
    return events.groupBy(by).agg(F.max_by(status, F.struct(time, F.col(seq))).alias("status"))


def stale(jobs: DataFrame, now: Column, limit: float = 90.0) -> DataFrame:
    """Running jobs without a heartbeat for over ``limit`` seconds are failed."""
    lost = (F.col("status") == "running") & (now - F.col("updated") > limit)
    return jobs.withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def repair_on_start(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def completed_without(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Completed jobs that have no artifact."""
    have = artifacts.select(F.col("job_id").alias("_j")).distinct()
    return jobs.where("status = 'completed'").join(have, F.col("id") == F.col("_j"), "left_anti")


def stage_times(events: DataFrame, by: str, time: Column, seq: str) -> DataFrame:
    """Adds the seconds since the job's previous event."""
    w = Window.partitionBy(by).orderBy(time, F.col(seq))
    return events.withColumn("elapsed", F.coalesce(time - F.lag(time).over(w), F.lit(0.0)))


def first_available(candidates: DataFrame, by: str, path: str, priority: str) -> DataFrame:
    return candidates.groupBy(by).agg(F.min_by(path, F.struct(priority, path)).alias(path))


def valid_name(name: Column) -> Column:
    """1 to 160 characters without the blanks around them."""
    return F.coalesce(F.length(F.trim(name)).between(1, 160), F.lit(False))


def apply_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """A catalogue after a batch of changes ``(id, seq, at, op, name)``: update, archive, restore or delete, later ones winning.

    ``rows`` has ``id``, ``name``, ``archived_at`` and ``updated_at``. Updates with a name that is not valid
    change nothing; changes of unknown or null ids are ignored; a deleted row goes whatever else is asked.
    One aggregate by id and one join.
    """
    op, turn = F.col("op"), F.struct("at", "seq")
    named, moved = (op == "update") & valid_name(F.col("name")), op.isin("archive", "restore")
    last = changes.groupBy(F.col("id").alias("_id")).agg(
        F.max_by(F.trim("name"), F.when(named, turn)).alias("_name"), F.max_by(F.when(op == "archive", F.col("at")), F.when(moved, turn)).alias("_archived"),
        F.coalesce(F.bool_or(moved), F.lit(False)).alias("_moved"), F.max(F.when(named | moved, F.col("at"))).alias("_at"), F.coalesce(F.bool_or(op == "delete"), F.lit(False)).alias("_gone"),
    )
    out = rows.join(last, F.col("id") == F.col("_id"), "left").where(~F.coalesce("_gone", F.lit(False)))
    return out.withColumns({"name": F.coalesce("_name", "name"), "archived_at": F.when(F.col("_moved"), F.col("_archived")).otherwise(F.col("archived_at")), "updated_at": F.coalesce("_at", "updated_at")}).select(rows.columns)
