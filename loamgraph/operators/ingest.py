"""Content-hash deduplication of incoming texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_batch(batch: DataFrame, history: DataFrame) -> DataFrame:
    """(id, content_hash, status, existing_id) for each text of a batch (id, agent_id, content, force).

    A text is skipped if its agent already stored it, in history (agent_id, content_hash, id) or earlier in the
    batch; force stores it anyway. Null texts fail. Nothing of the history but hashes is read.
    """
    b = batch.withColumn("content_hash", F.sha2("content", 256))
    seen = history.where("content_hash is not null").groupBy(F.col("agent_id").alias("ha"), F.col("content_hash").alias("hh")).agg(F.min("id").alias("old_id"))
    first = F.min("id").over(Window.partitionBy("agent_id", "content_hash"))
    x = b.withColumn("first_id", F.when(F.col("content_hash").isNotNull(), first)).join(seen, F.col("agent_id").eqNullSafe(F.col("ha")) & (F.col("content_hash") == F.col("hh")), "left")
    old = F.coalesce("old_id", F.when(F.col("first_id") < F.col("id"), F.col("first_id")))
    status = F.when(F.col("content").isNull(), "failed").when(F.coalesce("force", F.lit(False)), "stored").when(old.isNotNull(), "skipped").otherwise("stored")
    return x.select("id", "content_hash", status.alias("status"), F.when(status == "skipped", old).alias("existing_id"))
