"""The job queue as tables: listing, timelines, stuck jobs, cancel and retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import numbered


def timeline(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(id, task_name, status, deferred_at, started_at, finished_at): first deferral, last start, last end; null where there is none."""
    per = events.groupBy("job_id").agg(
        F.min(F.when(F.col("type") == "deferred", F.col("at"))).alias("deferred_at"), F.max(F.when(F.col("type") == "started", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("type").isin("succeeded", "failed"), F.col("at"))).alias("finished_at"),
    )
    return jobs.select("id", "task_name", "status").join(per, F.col("id") == F.col("job_id"), "left").drop("job_id")


def stuck(jobs: DataFrame, events: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """(id, task_name, waiting_minutes): jobs that still wait after `minutes`."""
    t = timeline(jobs, events).where("status in ('todo', 'doing')")
    wait = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.coalesce("started_at", "deferred_at"))) / F.lit(6e7)
    return t.select("id", "task_name", wait.alias("waiting_minutes")).where(F.col("waiting_minutes") > minutes)


def cancel(jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, events): waiting jobs among ids become cancelled, with one event each."""
    hit = jobs.where("status = 'todo'").join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id").select("id", "_hit")
    out = jobs.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), "cancelled").otherwise(F.col("status"))).drop("_hit")
    return out, hit.select(F.col("id").alias("job_id"), F.lit("cancelled").alias("type"))


def retry(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """New waiting jobs for the failed or cancelled ones among ids, numbered after the largest id in id order."""
    hit = jobs.where("status in ('failed', 'cancelled')").join(ids.select("id").distinct(), "id", "left_semi")
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return numbered(hit, ["id"], "nr").crossJoin(F.broadcast(top)).withColumn("old_id", F.col("id")).withColumn("id", F.col("top") + F.col("nr")).withColumn("status", F.lit("todo")).drop("top", "nr")


def enqueue(episodes: DataFrame, queue: str = "extraction") -> DataFrame:
    """(episode_id, task_name, queue_name, status, attempts): a waiting job per episode (id, graph_name), to be routed first where it names no graph."""
    return episodes.where("id is not null").select(
        F.col("id").alias("episode_id"), F.when(F.col("graph_name").isNull(), "route_episode").otherwise("extract_episode").alias("task_name"), F.lit(queue).alias("queue_name"),
        F.lit("todo").alias("status"), F.lit(0).cast("bigint").alias("attempts"),
    ).distinct()


def run_attempts(waiting: DataFrame, works: Column, most: int = 3) -> DataFrame:
    """Jobs after at most `most` attempts: a job whose condition holds succeeds at the first, one that fails is tried again until none are left; null fails."""
    ok = F.coalesce(works, F.lit(False))
    return waiting.withColumn("attempts", F.when(ok, 1).otherwise(most).cast("bigint")).withColumn("status", F.when(ok, "succeeded").otherwise("failed"))
