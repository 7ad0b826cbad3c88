"""Changes of grants and of who administers, as functions from tables and a delta to the new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["agent_id", "graph_name"]


def grant(grants: DataFrame, delta: DataFrame) -> DataFrame:
    """Grants (agent_id, graph_name, can_read, can_write) after delta of the same columns: a pair's flags are those of the delta; of repeated pairs the most permissive."""
    d = delta.where("agent_id is not null and graph_name is not null").groupBy(*_KEY).agg(F.max("can_read").alias("can_read"), F.max("can_write").alias("can_write"))
    return grants.join(d, _KEY, "left_anti").select(*_KEY, "can_read", "can_write").unionByName(d)


def revoke(grants: DataFrame, pairs: DataFrame) -> DataFrame:
    """Grants without the given pairs; a pair that was never granted changes nothing."""
    return grants.join(pairs.select(*_KEY), _KEY, "left_anti")


def set_admin(agents: DataFrame, delta: DataFrame, bootstrap: str) -> DataFrame:
    """Agents (agent_id, is_admin) after delta of the same columns; the bootstrap agent stays an administrator, unknown agents are added."""
    d = delta.where("agent_id is not null").groupBy("agent_id").agg(F.max("is_admin").alias("now"))
    both = agents.select("agent_id", "is_admin").join(d, "agent_id", "full")
    return both.select("agent_id", (F.coalesce("now", "is_admin") | (F.col("agent_id") == bootstrap)).alias("is_admin"))
