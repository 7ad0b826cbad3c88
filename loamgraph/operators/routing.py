"""Routing of episodes to domains and of agents to graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard

# Key words of the shared domains.
KEYWORDS = {
    "user_profile": "prefer goal habit like dislike want value opinion",
    "technical_knowledge": "python react api database framework library code architecture",
    "work_context": "project task deadline meeting team milestone sprint",
    "domain_knowledge": "concept theory fact research trend industry",
}
THRESHOLD = 0.3


def classify(texts: DataFrame, confidence: float = 0.8) -> DataFrame:
    """(id, slug, confidence): a row per domain of which a key word occurs in the lower-case text; null texts match none."""
    low = F.lower("text")
    hits = [F.when(_any(low, words.split()), F.lit(slug)) for slug, words in KEYWORDS.items()]
    found = texts.select("id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("slug"))
    return found.select("id", "slug", F.lit(confidence).alias("confidence"))


def _any(text, words):
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def route(texts: DataFrame, domains: DataFrame, permissions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, agent_id, slug, graph_name, confidence): classified episodes whose agent may write to the domain's shared graph."""
    hit = classify(texts.select("id", "text")).where(F.col("confidence") >= threshold)
    named = hit.join(F.broadcast(domains.select("slug", "graph_name")), "slug")
    return named.join(texts.select("id", "agent_id"), "id").join(permissions.where("can_write").select("agent_id", "graph_name"), ["agent_id", "graph_name"], "left_semi").select(
        "id", "agent_id", "slug", "graph_name", "confidence"
    )


def provision(proposed: DataFrame, domains: DataFrame) -> DataFrame:
    """(slug, parent_id, depth, path, schema_name, confidence): the rows for proposed domains (slug, parent_slug, depth and path in domains) that do not exist yet.

    domains: (id, slug, depth, path). An unknown or missing parent makes a root; a slug proposed twice takes the smallest parent. Proposed domains count with confidence 0.6.
    """
    one = proposed.where("slug is not null and slug <> ''").groupBy("slug").agg(F.min("parent_slug").alias("parent_slug")).join(domains.select("slug"), "slug", "left_anti")
    up = domains.groupBy(F.col("slug").alias("parent_slug")).agg(F.min(F.struct("id", "depth", "path")).alias("x"))
    return one.join(up, "parent_slug", "left").select(
        "slug", F.col("x.id").alias("parent_id"), F.coalesce(F.col("x.depth") + 1, F.lit(0)).cast("bigint").alias("depth"), F.concat_ws(".", "x.path", "slug").alias("path"),
        F.concat(F.lit("ncx_shared__"), "slug").alias("schema_name"), F.lit(0.6).alias("confidence"),
    )


def inherited(domains: DataFrame) -> DataFrame:
    """(id, schema_name) of domains (id, parent_id, schema_name): the own one, else that of the nearest ancestor, at any depth.

    Pointers to the nearest ancestor not yet looked at are doubled until no domain without a schema has one left, at most
    as often as the logarithm of the number of domains; what then still points runs in a cycle without a schema.
    """
    state = cut(domains.select("id", "schema_name", F.when(F.col("schema_name").isNull(), F.col("parent_id")).alias("up")))
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where("up is not null").isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("schema_name").alias("s2"), F.col("up").alias("up2"))
        new = cut(state.join(above, "up", "left").select("id", F.coalesce("schema_name", "s2").alias("schema_name"), F.when(F.coalesce("schema_name", "s2").isNull(), F.col("up2")).alias("up")))
        discard(state)
        state = new
    return state.select("id", "schema_name")


def readable(registry: DataFrame, permissions: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, graph_name, priority): graphs an agent sees: its own, shared ones by grant, all for admins; personal graphs first."""
    own = agents.join(registry.where("not is_shared"), "owner").select("agent_id", "graph_name", "purpose")
    shared = registry.where("is_shared").select("graph_name", "purpose")
    granted = permissions.where("can_read").join(shared, "graph_name").select("agent_id", "graph_name", "purpose")
    admin = agents.where("is_admin").select("agent_id").crossJoin(F.broadcast(shared)).select("agent_id", "graph_name", "purpose")
    both = own.unionByName(granted).unionByName(admin).distinct()
    return both.select("agent_id", "graph_name", F.when(F.col("purpose") == "personal", 0).otherwise(1).alias("priority"))
