"""Session-ordered episodes: running numbers, predecessors, neighbours and clusters.

Episodes are (id, agent_id, session_id, created_at, ...). An episode without a session has no number,
no predecessor and no neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order():
    return Window.partitionBy("agent_id", "session_id").orderBy("created_at", "id")


def with_sequence(episodes: DataFrame) -> DataFrame:
    """Adds session_sequence, counted from 1 by (created_at, id)."""
    return episodes.withColumn("session_sequence", F.when(F.col("session_id").isNotNull(), F.row_number().over(_order())).cast("bigint"))


def with_previous(episodes: DataFrame) -> DataFrame:
    """Adds prev_id, the episode before in the session."""
    return episodes.withColumn("prev_id", F.when(F.col("session_id").isNotNull(), F.lag("id").over(_order())))


def neighbours(episodes: DataFrame, nuclei: DataFrame, window: int = 3) -> DataFrame:
    """(id, neighbour_id, offset): per nucleus the max(1, window // 3) episodes before it and max(1, window - before) after it.

    Neighbours are gathered by a bounded window frame, so a long session is never joined with itself.
    """
    before = max(1, window // 3)
    after = max(1, window - before)
    frame = _order().rowsBetween(-before, after)
    e = with_sequence(episodes.where("session_id is not null"))
    near = e.select("id", F.col("session_sequence").alias("at"), F.collect_list(F.struct(F.col("id").alias("n"), F.col("session_sequence").alias("s"))).over(frame).alias("x"))
    near = near.join(nuclei.select("id").distinct(), "id", "left_semi")
    return near.select("id", "at", F.explode("x").alias("y")).where("y.n <> id").select("id", F.col("y.n").alias("neighbour_id"), (F.col("y.s") - F.col("at")).alias("offset"))


def clustered(ranked: DataFrame) -> DataFrame:
    """Adds position: sessions stand where their best-scoring member stands, their members in order of time.

    ranked: a bounded result list (id, session_id, created_at, score); it is ordered in one task.
    """
    r = ranked.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("_k", F.coalesce("session_id", F.concat(F.lit("id "), F.col("id").cast("string"))))
    r = r.withColumn("_c", F.min("_r").over(Window.partitionBy("_k")))
    return r.withColumn("position", F.row_number().over(Window.orderBy("_c", "created_at", "id")).cast("bigint")).drop("_r", "_k", "_c")
