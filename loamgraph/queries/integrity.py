"""Queries of the hierarchy and reference operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import references as R
from ..runtime import cut, table
from ..views import latest


def records(spark: SparkSession, d: str) -> DataFrame:
    dom = table(spark, d, "semantic_domains").select("id", "slug", "parent_id", "updated_at")
    cls = table(spark, d, "ontology_classes").select("class_id", "parent_class_id")
    return H.links(latest(dom, "id", "updated_at"), "id", "parent_id", "slug", "domain").unionByName(
        H.links(cls, "class_id", "parent_class_id", "class_id", "class")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(records(spark, d), with_nodes=False).select(
        F.col("grp").alias("tree"), F.col("node").alias("node_key"), F.col("root").alias("root_key"),
        F.col("depth").alias("node_depth"), F.col("path").alias("full_path"),
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(records(spark, d))).withColumnRenamed("grp", "tree")


def p1_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Size and height of the subtree of every record; records on or below a cycle are in no tree."""
    rec = cut(records(spark, d))
    peeled = H.peel(rec)
    depth = H.hierarchy(rec, False, peeled).select("grp", "node", "depth")
    got = depth.join(H.subtree_sizes(rec, peeled), ["grp", "node"])
    lost = F.col("depth") < 0
    return got.select(
        F.col("grp").alias("tree"), F.col("node").alias("node_key"), F.col("depth").alias("node_depth"),
        F.when(lost, 0).otherwise(F.col("subtree_size")).cast("bigint").alias("subtree_size"), F.when(lost, -1).otherwise(F.col("height")).cast("bigint").alias("height"),
    )


_P1 = """with recursive rec as (
  select 'domain' as tree, cast(id as varchar) as k, cast(parent_id as varchar) as p, slug as l
  from (select *, row_number() over (partition by id order by updated_at desc nulls last) as rn from semantic_domains) where rn = 1
  union all
  select distinct 'class', class_id, nullif(trim(parent_class_id), ''), class_id from ontology_classes where class_id is not null),
lk as (select a.tree, a.k, b.k as p, a.l from rec a left join rec b on a.tree = b.tree and a.p = b.k),
down as (
  select tree, k, k as root, cast(0 as bigint) as depth, l as path, [k] as keys from lk where p is null
  union all
  select c.tree, c.k, d.root, d.depth + 1, d.path || '.' || c.l, list_append(d.keys, c.k) from down d join lk c on c.tree = d.tree and c.p = d.k),
bad as (select * from lk where not exists (select 1 from down where down.tree = lk.tree and down.k = lk.k)),
up as (
  select tree, k as s, p as c from bad
  union
  select up.tree, up.s, bad.p from up join bad on bad.tree = up.tree and bad.k = up.c),
alls as (
  select tree, k, root, depth, path, keys from down
  union all
  select tree, k, '', cast(case when exists (select 1 from up where up.tree = bad.tree and up.s = bad.k and up.c = bad.k) then -1 else -2 end as bigint), '', cast([] as varchar[]) from bad)
"""


def _ref_tables(spark: SparkSession, d: str):
    nodes = cut(latest(table(spark, d, "graph_nodes").select("graph_name", "id", "type_id", "forgotten_at", "created_at", "updated_at"), "id", "updated_at"))
    edges = table(spark, d, "graph_edges").select("graph_name", "id", "source_id", "target_id", "created_at").distinct()
    return nodes, edges, table(spark, d, "graph_node_types").select("id", "created_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, types = _ref_tables(spark, d)
    ends = F.explode(F.array(
        F.struct(F.lit("edge.source_id").alias("f"), F.col("source_id").alias("k")),
        F.struct(F.lit("edge.target_id").alias("f"), F.col("target_id").alias("k")),
    ))
    refs = edges.select("graph_name", "id", "created_at", ends.alias("e")).select(
        F.col("e.f").alias("ref_field"), F.col("graph_name").alias("scope"), F.col("id").alias("row_id"), F.col("e.k").alias("ref_key"), F.col("created_at").alias("at")
    )
    refs = refs.unionByName(nodes.select(
        F.lit("node.type_id").alias("ref_field"), F.lit("").alias("scope"), F.col("id").alias("row_id"), F.col("type_id").alias("ref_key"), F.col("created_at").alias("at")
    ))
    side = nodes.select(F.col("graph_name").alias("scope"), F.col("id").alias("ref_key"), F.col("created_at").alias("born"), F.col("forgotten_at").alias("gone"))
    targets = (
        side.withColumn("ref_field", F.lit("edge.source_id"))
        .unionByName(side.withColumn("ref_field", F.lit("edge.target_id")))
        .unionByName(types.select(
            F.lit("").alias("scope"), F.col("id").alias("ref_key"), F.col("created_at").alias("born"), F.lit(None).cast("timestamp").alias("gone"), F.lit("node.type_id").alias("ref_field")
        ))
    )
    return R.classify(refs, targets).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(p4_found(spark, d))


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """The orphan keys of the state after four deliveries of changes, by quarter of the year; forgetting a node is a delta of -1."""
    nodes, edges, types = _ref_tables(spark, d)
    g, one = F.col("graph_name"), F.lit("")
    made, gone = F.col("created_at"), F.col("forgotten_at")
    state = None
    for quarter in (1, 2, 3, 4):
        due = lambda df, at: df.where(F.coalesce(F.quarter(at), F.lit(1)) == quarter)  # noqa: B023, E731
        forgot = nodes.where(gone.isNotNull() & (F.quarter(gone) == quarter))
        deltas = [
            R.reference_deltas(due(edges, made), "edge.source_id", g, F.col("source_id")), R.reference_deltas(due(edges, made), "edge.target_id", g, F.col("target_id")),
            R.existence_deltas(due(nodes, made), "edge.source_id", g, F.col("id")), R.existence_deltas(due(nodes, made), "edge.target_id", g, F.col("id")),
            R.existence_deltas(forgot, "edge.source_id", g, F.col("id"), -1), R.existence_deltas(forgot, "edge.target_id", g, F.col("id"), -1),
            R.reference_deltas(due(nodes, made), "node.type_id", one, F.col("type_id")), R.existence_deltas(due(types, made), "node.type_id", one, F.col("id")),
        ]
        state = R.fold(*([state] if state else []), *deltas)
    return R.current_orphans(state).select("ref_field", "scope", "ref_key", "refs", "alive")


_P4 = """with n as (select * from (select *, row_number() over (partition by id order by updated_at desc nulls last) as rn from graph_nodes where id is not null) where rn = 1),
e as (select distinct graph_name, id, source_id, target_id, created_at from graph_edges),
refs as (
  select 'edge.source_id' as ref_field, graph_name as scope, id as row_id, source_id as ref_key, created_at as at from e
  union all select 'edge.target_id', graph_name, id, target_id, created_at from e
  union all select 'node.type_id', '', id, type_id, created_at from n),
tgt as (
  select 'edge.source_id' as ref_field, graph_name as scope, id as ref_key, created_at as born, forgotten_at as gone from n
  union all select 'edge.target_id', graph_name, id, created_at, forgotten_at from n
  union all select 'node.type_id', '', id, created_at, null from graph_node_types),
found as (
  select distinct ref_field, row_id, ref_key, orphan_kind, period from (
    select r.ref_field, r.row_id, r.ref_key, strftime(r.at, '%Y-%m') as period,
      case when t.ref_key is null then 'missing' when t.gone < r.at then 'deleted' when t.born > r.at then 'late' end as orphan_kind
    from refs r left join tgt t on r.ref_field = t.ref_field and r.scope = t.scope and r.ref_key = t.ref_key
    where r.ref_key is not null) where orphan_kind is not null)
"""

QUERIES = {
    "p1_found": p1_found, "p1_descendants": p1_descendants, "p1_subtrees": p1_subtrees,
    "p4_found": p4_found, "p4_report": p4_report, "p4_keys": p4_keys,
}
SQL = {
    "p1_found": _P1 + "select tree, k as node_key, root as root_key, depth as node_depth, path as full_path from alls",
    "p1_descendants": _P1 + """select tree, a as ancestor, k as descendant, cast(depth - (i - 1) as bigint) as distance from
      (select tree, k, depth, unnest(keys) as a, generate_subscripts(keys, 1) as i from alls where depth > 0) where a <> k""",
    "p1_subtrees": _P1 + """, s as (select tree, a, count(*) as n, max(depth - (i - 1)) as h from
      (select tree, depth, unnest(keys) as a, generate_subscripts(keys, 1) as i from alls where depth >= 0) group by 1, 2)
      select alls.tree, k as node_key, depth as node_depth, coalesce(n, 0) as subtree_size, cast(coalesce(h, -1) as bigint) as height
      from alls left join s on s.tree = alls.tree and s.a = alls.k""",
    "p4_found": _P4 + "select * from found",
    "p4_report": _P4 + "select ref_field, period, orphan_kind, count(*) as n_refs, count(distinct ref_key) as n_keys from found group by 1, 2, 3",
    "p4_keys": _P4 + """, a as (select ref_field, scope, ref_key, count(*) as refs from refs where ref_key is not null group by 1, 2, 3)
      select a.ref_field, a.scope, a.ref_key, a.refs, cast(0 as bigint) as alive from a
      where not exists (select 1 from tgt t where t.ref_field = a.ref_field and t.scope = a.scope and t.ref_key = a.ref_key and t.gone is null)""",
}
