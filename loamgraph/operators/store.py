"""State changes as functions from a table and a delta to the new table.

Parquet tables cannot be updated in place; each change yields the next version of the table, which
`write_version` puts into a new folder. Deltas are folded first (one row per key), so that the result does
not depend on the order of rows inside a delta.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import reinforced
from ..runtime import numbered
from .pairs import look_up

# Groups of node types whose names drift into each other, and pairs that never mean the same.
MERGE_SAFE = [
    "Tool Project Software SoftwareTool Framework Library Technology", "Person PersonRole TeamMember Employee Researcher Engineer Scientist Developer",
    "Organization Company Team Group Department", "Concept Topic Subject Theme Idea Theory Principle", "Methodology Method Approach Strategy Technique ProcessStage",
    "Protocol Standard Specification", "Document Resource Article Paper Report", "Event Milestone", "Metric Measurement Score KPI Statistic Indicator", "Dataset Data DataSource DataStore",
]
HOMONYMS = ["Drug Neurotransmitter", "Person Organization", "Language Country", "Metric MetricUnit"]
# Equivalent types and the one that stays.
TYPE_MERGES = {
    "AnatomicalLocation": "BodyPart", "AnatomicalStructure": "BodyPart", "HealthActivity": "Activity", "SportActivity": "Activity", "ArchitectureConcept": "Concept",
    "TechnicalArchitecture": "ArchitecturePattern", "HealthState": "Symptom", "Condition": "Symptom",
}
# The types every graph starts with.
SEED_NODE_TYPES = "Concept Person Document Event Tool Preference Organization Location Project Activity Asset Substance Metric Symptom Goal Task Emotion Recipe Protocol Routine".split()
SEED_EDGE_TYPES = (
    "RELATES_TO MENTIONS CAUSED_BY FOLLOWS AUTHORED USES CONTRADICTS SUPPORTS SUMMARIZES DERIVED_FROM SUPERSEDES CORRECTS HAS_GOAL WORKS_ON WORKS_FOR LOCATED_AT PART_OF EXPERIENCED CONSUMES PERFORMS OWNS RECOMMENDS IMPROVES"
).split()


def merge_safe(a: Column, b: Column) -> Column:
    """Whether two type names likely mean the same: equal, or in one group, or one begins with the other; homonyms never; null never."""
    la, lb = F.lower(a), F.lower(b)
    homonym = reduce(lambda x, y: x | y, [a.isin(p.split()) & b.isin(p.split()) for p in HOMONYMS])
    group = reduce(lambda x, y: x | y, [la.isin(g.lower().split()) & lb.isin(g.lower().split()) for g in MERGE_SAFE])
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), False).when(a == b, True).when(homonym, False).otherwise(group | F.startswith(la, lb) | F.startswith(lb, la))


def merge_maps(old: Column, new: Column) -> Column:
    """Keys of both, the new value where both have one; null only if both are null."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(old.isNull() & new.isNull(), None).otherwise(F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, a, b: F.coalesce(b, a)))


def fold_delta(delta: DataFrame) -> DataFrame:
    """One row per (graph_name, canonical name) of delta (graph_name, name, type_name, content, importance, seq): last non-null content and type, largest importance."""
    d = delta.withColumn("name", T.canonical_name(F.col("name"))).where("name is not null and name <> ''")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return d.groupBy("graph_name", F.lower("name").alias("key")).agg(F.max_by("name", "seq").alias("name"), last("type_name").alias("type_name"), last("content").alias("content"), F.max("importance").alias("importance"))


def match_nodes(delta: DataFrame, nodes: DataFrame, aliases: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Folded delta rows with node_id and tier of the node they mean: 1 same name, 2 alias, 3 similar name (the most similar), null none.

    nodes: (graph_name, id, name, type_name); aliases: (graph_name, alias, node_id). Within a tier a node of the same
    type comes first, then the smallest id; a match counts only if its type is merge-safe with the asked one.
    Similar names are looked up by shared trigrams, and only for rows without a better match.
    """
    n = nodes.where("name is not null").select(F.col("graph_name"), F.col("id").alias("node_id"), F.lower("name").alias("nkey"), F.col("type_name").alias("ntype"))
    d = delta.select("graph_name", "key", "type_name")
    exact = d.join(n, (d["graph_name"] == n["graph_name"]) & (d["key"] == n["nkey"])).select(d["graph_name"], "key", "type_name", "node_id", "ntype", F.lit(1).alias("tier"), F.lit(1.0).alias("sim"))
    a = aliases.select(F.col("graph_name").alias("ag"), F.lower("alias").alias("alias"), F.col("node_id").alias("aid"))
    al = d.join(a, (d["graph_name"] == a["ag"]) & (d["key"] == a["alias"])).join(n.select(F.col("node_id").alias("aid"), "ntype"), "aid").select("graph_name", "key", "type_name", F.col("aid").alias("node_id"), "ntype", F.lit(2).alias("tier"), F.lit(1.0).alias("sim"))
    known = exact.unionByName(al)
    left = d.join(known.select("graph_name", "key"), ["graph_name", "key"], "left_anti")
    near = look_up(left.select(F.col("graph_name").alias("grp"), F.col("key").alias("name")), n.select(F.col("graph_name").alias("grp"), F.col("nkey").alias("name")), threshold)
    named = near.select(F.col("grp").alias("graph_name"), F.col("name").alias("key"), F.col("other").alias("nkey"), "sim")
    sim = named.join(left, ["graph_name", "key"]).join(n, ["graph_name", "nkey"]).select("graph_name", "key", "type_name", "node_id", "ntype", "sim")
    both = known.unionByName(sim.withColumn("tier", F.lit(3)).select(known.columns))
    ok = both.where(F.col("type_name").isNull() | F.col("ntype").isNull() | merge_safe(F.col("ntype"), F.col("type_name")))
    w = Window.partitionBy("graph_name", "key").orderBy("tier", F.desc("sim"), F.desc(F.coalesce(F.col("ntype") == F.col("type_name"), F.lit(False))), "node_id")
    best = ok.withColumn("r", F.row_number().over(w)).where("r = 1").select("graph_name", "key", "node_id", "tier")
    return delta.join(best, ["graph_name", "key"], "left")


def upsert_nodes(nodes: DataFrame, matched: DataFrame, as_of: str) -> DataFrame:
    """The next node table (graph_name, id, name, content, importance, access_count, forgotten, updated_at).

    Matched nodes take over content if given and the larger importance, and come back if forgotten (one access more);
    the others are inserted with ids after the largest, in order of graph and name.
    """
    now = F.lit(as_of).cast("timestamp")
    hit = matched.where("node_id is not null").groupBy(F.col("node_id").alias("id")).agg(F.max_by("content", F.struct(F.col("content").isNotNull(), "key")).alias("c2"), F.max("importance").alias("i2"), F.lit(True).alias("hit"))
    old = nodes.join(hit, "id", "left").select(
        "graph_name", "id", "name", F.coalesce("c2", "content").alias("content"), F.greatest("importance", "i2").alias("importance"),
        (F.coalesce("access_count", F.lit(0)) + F.when(F.col("hit") & F.col("forgotten"), 1).otherwise(0)).cast("int").alias("access_count"),
        (F.col("forgotten") & F.col("hit").isNull()).alias("forgotten"), F.when(F.col("hit"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = numbered(matched.where("node_id is null"), ["graph_name", "key"], "nr").crossJoin(F.broadcast(top)).select(
        "graph_name", (F.col("top") + F.col("nr")).cast("bigint").alias("id"), "name", "content", F.coalesce("importance", F.lit(0.5)).alias("importance"),
        F.lit(0).alias("access_count"), F.lit(False).alias("forgotten"), now.alias("updated_at"),
    )
    return old.unionByName(new)


def upsert_edges(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """The next edge table of (graph_name, source_id, target_id, type_id, weight) from a delta of the same columns and seq.

    A pair with exactly one edge, of another type, has it retyped; else the edge of that type is updated or inserted. The last row of a key wins.
    """
    key = ["graph_name", "source_id", "target_id"]
    d = delta.where("source_id is not null and target_id is not null").groupBy(*key, "type_id").agg(F.max_by("weight", "seq").alias("w2"), F.max("seq").alias("s2"))
    one_new = d.groupBy(*key).agg(F.count("*").alias("dn"), F.max_by("type_id", "s2").alias("dt"), F.max_by("w2", "s2").alias("dw"))
    per = edges.groupBy(*key).agg(F.count("*").alias("n"))
    pair = one_new.join(per, key).where("n = 1 and dn = 1").select(*key, "dt", "dw")
    old = edges.join(pair, key, "left").select(*key, F.coalesce("dt", "type_id").alias("type_id"), F.coalesce("dw", "weight").alias("weight"))
    rest = d.join(pair.select(*key), key, "left_anti")
    both = old.join(rest.select(*key, "type_id", "w2", F.lit(True).alias("in_delta")), [*key, "type_id"], "full")
    return both.select(*key, "type_id", F.when(F.col("in_delta"), F.col("w2")).otherwise(F.col("weight")).alias("weight"))


def reinforce(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with the ones among ids (graph_name, id) reinforced."""
    hit = ids.select("graph_name", "id").distinct().withColumn("_hit", F.lit(True))
    return edges.join(hit, ["graph_name", "id"], "left").withColumn("weight", F.when(F.col("_hit"), reinforced(F.col("weight"))).otherwise(F.col("weight"))).drop("_hit")


def forgettable(nodes: DataFrame, as_of: str, importance: float = 0.3, idle_days: int = 7) -> DataFrame:
    """Ids of live nodes of low importance, never accessed, and idle for long."""
    idle = F.coalesce("last_accessed_at", "created_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {idle_days} days")
    return nodes.where(~F.col("forgotten") & (F.col("importance") < importance) & (F.col("access_count") == 0) & idle).select("id")


def register(table: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Append the rows of delta whose key is not there; of rows with one key one is kept."""
    new = delta.select(*table.columns).dropDuplicates(key).join(table.select(*key), key, "left_anti")
    return table.unionByName(new)


def merge_types(nodes: DataFrame, types: DataFrame, merges: dict[str, str] = TYPE_MERGES) -> tuple[DataFrame, DataFrame]:
    """(nodes, types) after moving nodes of equivalent types to the one that stays; only where both types exist."""
    spark = types.sparkSession
    m = spark.createDataFrame(sorted(merges.items()), "src string, dst string")
    a, b = types.select(F.col("id").alias("src_id"), F.col("name").alias("src")), types.select(F.col("id").alias("dst_id"), F.col("name").alias("dst"))
    move = F.broadcast(m.join(a, "src").join(b, "dst").select("src_id", "dst_id"))
    out = nodes.join(move, nodes["type_id"] == move["src_id"], "left").withColumn("type_id", F.coalesce("dst_id", "type_id")).drop("src_id", "dst_id")
    return out, types.join(move, types["id"] == move["src_id"], "left_anti")


def mapped_types(nodes: DataFrame, types: DataFrame, merges: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """As merge_types, but a missing target type is created, with the ids after the largest in order of name; its rows have no other columns."""
    have = {r["name"] for r in types.select("name").collect()}  # the type list is short and fixed
    top = types.agg(F.max("id")).first()[0] or 0
    missing = sorted({b for a, b in merges.items() if a in have} - have)
    made = types.sparkSession.createDataFrame([(top + i, n) for i, n in enumerate(missing, 1)], "id bigint, name string")
    return merge_types(nodes, types.unionByName(made, allowMissingColumns=True), merges)


def resolve_ends(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds source_id, target_id and state to edges asked for by names (graph_name, source, target, ...): ends are the smallest node id of the name in the graph, case aside.

    state: 'found', or which end is missing, the source first.
    """
    n = nodes.where("name is not null").groupBy("graph_name", F.lower("name").alias("k")).agg(F.min("id").alias("i"))
    out = asked
    for end in ("source", "target"):
        out = out.withColumn("k", F.lower(end)).join(n.withColumnRenamed("i", f"{end}_id"), ["graph_name", "k"], "left").drop("k")
    return out.withColumn("state", F.when(F.col("source_id").isNull(), "source missing").when(F.col("target_id").isNull(), "target missing").otherwise("found"))


def unused_types(types: DataFrame, used: DataFrame, keep: list[str], before: Column | None = None) -> DataFrame:
    """Types outside keep that no row of used (type_id) has, created before a time if one is given."""
    t = types.where(~F.col("name").isin(keep))
    if before is not None:
        t = t.where(F.col("created_at") < before)
    return t.join(used.where("type_id is not null").select(F.col("type_id").alias("id")), "id", "left_anti")


def unused_per_graph(types: DataFrame, used: DataFrame, keep: list[str], before: Column | None = None) -> DataFrame:
    """The types of unused_types, per graph of used (graph_name, type_id); the type list is short and fixed."""
    own = used.where("graph_name is not null").select("graph_name", F.col("type_id").alias("id")).distinct()
    t = types.where(~F.col("name").isin(keep))
    if before is not None:
        t = t.where(F.col("created_at") < before)
    return own.select("graph_name").distinct().crossJoin(F.broadcast(t)).join(own, ["graph_name", "id"], "left_anti")


def set_embedding(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes with the embeddings given in vectors (id, new); the others and null vectors leave theirs. Of several vectors of an id one is taken."""
    one = vectors.where("id is not null").groupBy("id").agg(F.first("new", ignorenulls=True).alias("new"))
    return nodes.join(one, "id", "left").withColumn("embedding", F.coalesce("new", "embedding")).drop("new")


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a table version under root; a version is written once."""
    path = f"{root}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v{version:06d}")
