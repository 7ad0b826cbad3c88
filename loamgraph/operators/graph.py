"""Graph operators on edge lists: neighbourhoods, spreading activation, supersession, session links.

Depths are small constants, so each level is one more join of a lazy plan. Visited nodes are taken out by
anti-joins, and a node reached in several ways keeps the first by a fixed order. Edges of null weight
spread nothing. An edge list is (graph_name, id, source_id, target_id, type_id, weight).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import SPREAD_DECAY


def both_ways(edges: DataFrame) -> DataFrame:
    """(graph_name, node, nbr, edge_id, type_id, weight, direction): every edge seen from both ends; edges with a null end are left out."""
    e = edges.where("source_id is not null and target_id is not null")
    out = e.select("graph_name", F.col("source_id").alias("node"), F.col("target_id").alias("nbr"), F.col("id").alias("edge_id"), "type_id", "weight", F.lit("out").alias("direction"))
    inn = e.select("graph_name", F.col("target_id").alias("node"), F.col("source_id").alias("nbr"), F.col("id").alias("edge_id"), "type_id", "weight", F.lit("in").alias("direction"))
    return out.unionByName(inn)


def neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(graph_name, seed, node, distance, edge_id): nodes within depth of each seed (graph_name, id), the seed left out.

    A node keeps the edge that found it: at the smallest distance, outgoing before incoming, then the smallest edge id.
    """
    adj = both_ways(edges)
    seen = seeds.select("graph_name", F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("distance"), F.lit(None).cast("bigint").alias("edge_id"))
    front = seen
    for level in range(1, depth + 1):
        step = front.select("graph_name", "seed", "node").join(adj, ["graph_name", "node"])
        best = F.min(F.struct((F.col("direction") == "in").alias("i"), "edge_id")).alias("x")
        found = step.groupBy("graph_name", "seed", F.col("nbr").alias("node")).agg(best)
        front = found.join(seen.select("graph_name", "seed", "node"), ["graph_name", "seed", "node"], "left_anti").select(
            "graph_name", "seed", "node", F.lit(level).cast("bigint").alias("distance"), F.col("x.edge_id").alias("edge_id")
        )
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def spreading_activation(seeds: DataFrame, edges: DataFrame, depth: int = 2, decay: float = SPREAD_DECAY) -> DataFrame:
    """(graph_name, node, bonus): energy of all seeds (graph_name, id, score) spread over the edges, divided by the largest.

    Per seed a node is reached once, at its smallest distance and there by the strongest energy (ties: equal anyway).
    Energy falls to weight * decay per step.
    """
    adj = both_ways(edges).where("weight is not null").select("graph_name", "node", "nbr", "weight")
    seen = seeds.select("graph_name", F.col("id").alias("seed"), F.col("id").alias("node"), F.col("score").cast("double").alias("energy"), F.lit(0).alias("level"))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(adj, ["graph_name", "node"]).groupBy("graph_name", "seed", F.col("nbr").alias("node")).agg(F.max(F.col("energy") * F.col("weight") * decay).alias("energy"))
        front = step.join(seen.select("graph_name", "seed", "node"), ["graph_name", "seed", "node"], "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    total = seen.where("level > 0").groupBy("graph_name", "node").agg(F.sum("energy").alias("energy"))
    top = total.agg(F.max("energy").alias("top"))
    return total.crossJoin(F.broadcast(top)).select("graph_name", "node", F.when(F.col("top") > 0, F.col("energy") / F.col("top")).otherwise(0.0).alias("bonus"))


def supersession_flags(edges: DataFrame, edge_types: DataFrame) -> DataFrame:
    """(id, is_target, is_source) of nodes at the ends of SUPERSEDES and CORRECTS edges."""
    kinds = edge_types.where("name in ('SUPERSEDES', 'CORRECTS')").select(F.col("id").alias("type_id"))
    hit = edges.join(F.broadcast(kinds), "type_id", "left_semi")
    ends = hit.select(F.explode(F.array(F.struct(F.col("target_id").alias("id"), F.lit(True).alias("t")), F.struct(F.col("source_id").alias("id"), F.lit(False).alias("t")))).alias("x"))
    return ends.where("x.id is not null").groupBy(F.col("x.id").alias("id")).agg(F.bool_or(F.col("x.t")).alias("is_target"), F.bool_or(~F.col("x.t")).alias("is_source"))


def session_links(episodes: DataFrame, first_nodes: DataFrame) -> DataFrame:
    """FOLLOWS edges (source_id, target_id, weight) from the first node of an episode to that of the one before in its session."""
    w = Window.partitionBy("agent_id", "session_id").orderBy("created_at", "id")
    prev = episodes.where("session_id is not null").select("id", F.lag("id").over(w).alias("prev_id")).where("prev_id is not null")
    a = first_nodes.select(F.col("episode_id").alias("id"), F.col("node_id").alias("source_id"))
    b = first_nodes.select(F.col("episode_id").alias("prev_id"), F.col("node_id").alias("target_id"))
    return prev.join(a, "id").join(b, "prev_id").where("source_id <> target_id").select("source_id", "target_id", F.lit(0.9).alias("weight")).distinct()


def cascade_delete(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """The edges that remain when nodes (graph_name, id) are removed."""
    for end in ("source_id", "target_id"):
        edges = edges.join(removed.select("graph_name", F.col("id").alias(end)), ["graph_name", end], "left_anti")
    return edges
