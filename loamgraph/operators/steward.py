"""Health of graphs and domains, and proposals to split, merge, rename or drop them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the proposals.
SPLIT_NODES, SPLIT_TYPES, SPLIT_SHARE, UNDERUSED = 10, 6, 0.4, 1
MERGE_OVERLAP, DRIFT_NODES = 0.5, 3


def top_types(nodes: DataFrame, k: int) -> DataFrame:
    """(graph_name, types): ids of the k most used types of live nodes, ties by id."""
    c = nodes.where("not forgotten and type_id is not null and graph_name is not null").groupBy("graph_name", "type_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("graph_name").orderBy(F.desc("n"), "type_id")
    return c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("graph_name").agg(F.collect_list("type_id").alias("types"))


def health(nodes: DataFrame, edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """(graph_name, n_live, n_types, top_share, n_edges, n_routed) for every graph that has nodes."""
    live = nodes.where("graph_name is not null and not forgotten").groupBy("graph_name", "type_id").agg(F.count("*").alias("n"))
    per = live.groupBy("graph_name").agg(F.sum("n").alias("n_live"), F.count("type_id").alias("n_types"), (F.max("n") / F.sum("n")).alias("top_share"))
    e = edges.groupBy("graph_name").agg(F.count("*").alias("n_edges"))
    r = episodes.where("graph_name is not null").groupBy("graph_name").agg(F.count("*").alias("n_routed"))
    return per.join(e, "graph_name", "left").join(r, "graph_name", "left").na.fill(0, ["n_edges", "n_routed"])


def proposals(found: DataFrame) -> DataFrame:
    """(graph_name, proposal): split what is large, varied and not dominated by one type; retire what receives nothing while others do."""
    split = found.where((F.col("n_live") >= SPLIT_NODES) & (F.col("n_types") >= SPLIT_TYPES) & (F.col("top_share") <= SPLIT_SHARE)).select("graph_name", F.lit("split").alias("proposal"))
    top = found.agg(F.max("n_routed").alias("top"))
    idle = found.crossJoin(F.broadcast(top)).where((F.col("top") > 0) & (F.col("n_routed") <= UNDERUSED)).select("graph_name", F.lit("retire").alias("proposal"))
    return split.unionByName(idle)
