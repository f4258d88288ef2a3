"""The queue of learning jobs as relations: who is let in, what a worker claims, and what becomes of an attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_SECONDS, ATTEMPTS, LONGEST_WAIT, OPEN_JOBS, FINISHED_JOBS = 300, 3, 60, 256, 200
_OPEN, _DONE = ("queued", "running"), ("completed", "failed", "disabled")
JOB = "id string, status string, attempts int, ready_at timestamp, updated_at timestamp, error string"


def job_id(*identity: Column) -> Column:
    """A job is its reference: the same turn of the same file is the same job."""
    return F.sha2(F.to_json(F.struct(*identity)), 256)


def _later(at: str, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(at).cast("timestamp")) + (seconds * 1_000_000).cast("long"))


def enqueue(jobs: DataFrame, asked: DataFrame, at: str, room: int = OPEN_JOBS) -> tuple[DataFrame, DataFrame]:
    """(jobs, answers) after requests (id, seq): known jobs keep their status, new ones are let in by seq while there is room.

    answers: id, status (null where the queue is full), duplicate, error. A request that is made twice at once counts once.
    """
    first = asked.groupBy("id").agg(F.min("seq").alias("seq"))
    met = first.join(jobs.select("id", F.col("status").alias("known")), "id", "left")
    used = jobs.agg(F.count_if(F.col("status").isin(*_OPEN)).alias("used"))
    # what is let in is bounded by the room, so that its ranking sees no more than that
    new = met.where("known is null").orderBy("seq", "id").limit(room).withColumn("n", F.row_number().over(Window.orderBy("seq", "id")))
    let_in = new.crossJoin(used).where(F.col("n") + F.col("used") <= room).select("id")
    rows = let_in.select("id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(at).cast("timestamp").alias("ready_at"), F.lit(at).cast("timestamp").alias("updated_at"), F.lit("").alias("error"))
    told = met.join(let_in.withColumn("new", F.lit(True)), "id", "left")
    status = F.coalesce("known", F.when(F.col("new"), "queued"))
    answers = told.select("id", status.alias("status"), F.col("known").isNotNull().alias("duplicate"), F.when(status.isNull(), "queue_full").alias("error"))
    return jobs.select(*rows.columns).unionByName(rows), answers


def reclaimed(jobs: DataFrame, at: str, lease: int = LEASE_SECONDS) -> DataFrame:
    """Jobs whose worker has been silent for longer than its lease wait again."""
    now = F.lit(at).cast("timestamp")
    lost = (F.col("status") == "running") & (F.col("updated_at") < _later(at, F.lit(-lease)))
    return jobs.withColumns({"status": F.when(lost, "queued").otherwise(F.col("status")), "ready_at": F.when(lost, now).otherwise(F.col("ready_at"))})


def claim(jobs: DataFrame, at: str, workers: int = 1) -> DataFrame:
    """(id, status, attempts, updated_at): the jobs that ``workers`` workers take now, those that have been ready longest."""
    ready = jobs.where((F.col("status") == "queued") & (F.col("ready_at") <= F.lit(at).cast("timestamp")))
    taken = ready.orderBy("ready_at", "id").limit(workers)
    return taken.select("id", F.lit("running").alias("status"), (F.col("attempts") + 1).alias("attempts"), F.lit(at).cast("timestamp").alias("updated_at"))


def settle(jobs: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """Jobs after attempts (id, outcome: completed, disabled or failed, error): a failure waits twice as long each time, the third is the last.

    An outcome of a job that is not running any more, because its lease has ended, changes nothing.
    """
    met = jobs.join(outcomes.select("id", "outcome", F.col("error").alias("said")), "id", "left")
    told = F.col("outcome").isNotNull() & (F.col("status") == "running")
    retry = (F.col("outcome") == "failed") & (F.col("attempts") < ATTEMPTS)
    status = F.when(told, F.when(retry, "queued").otherwise(F.col("outcome"))).otherwise(F.col("status"))
    wait = F.least(F.lit(float(LONGEST_WAIT)), F.pow(F.lit(2.0), F.col("attempts")))
    return met.select(
        "id", status.alias("status"), "attempts", F.when(told, _later(at, wait)).otherwise(F.col("ready_at")).alias("ready_at"),
        F.when(told, F.lit(at).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"), F.when(told, F.coalesce("said", F.lit(""))).otherwise(F.col("error")).alias("error"),
    )


def pruned(jobs: DataFrame, keep: int = FINISHED_JOBS) -> DataFrame:
    """Open jobs, and the last finished ones: those are notes, not knowledge."""
    done = jobs.where(F.col("status").isin(*_DONE)).orderBy(F.desc("updated_at"), "id").limit(keep)
    return jobs.where(~F.col("status").isin(*_DONE)).unionByName(done)


def members(requests: DataFrame, runs: DataFrame, links: DataFrame) -> DataFrame:
    """Requests (run_id, project_key, knowledge_id) for records that a run of the project has made."""
    made = links.join(runs.select("run_id", "project_key"), "run_id").select("run_id", "project_key", "knowledge_id")
    return requests.join(made, ["run_id", "project_key", "knowledge_id"], "left_semi")
