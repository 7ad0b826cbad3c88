"""State changes: what a table looks like after an operation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import facts, graph, ingest, jobs, store
from ..runtime import cut, table
from ..views import AS_OF, sql
from .filters import tri_sim
from .scalars import canonical_sql


def x2_ingest(s, d):
    e = V.episodes(s, d).select("id", "agent_id", "content", F.col("force_flag").alias("force"), "batch_no")
    hist = e.where("batch_no = 0 and content is not null").select("agent_id", F.sha2("content", 256).alias("content_hash"), "id")
    return ingest.dedup_batch(e.where("batch_no >= 1"), hist).select("id", "status", "existing_id")


def _delta(s, d):
    """Names of the newest batch of requests as a delta: each ontology class label proposes a node in the work graph."""
    c = table(s, d, "ontology_classes").distinct()
    return c.where("label is not null").select(
        F.lit("ncx_shared__work_context").alias("graph_name"), F.col("label").alias("name"), F.initcap(F.element_at(F.split("label", " "), 1)).alias("type_name"),
        F.col("description").alias("content"), F.lit(0.6).alias("importance"), F.col("class_id").alias("seq"),
    )


def _typed_nodes(s, d):
    t = V.node_types(s, d).select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    n = V.nodes(s, d, "graph_name", "name", "type_id", "content", "importance", "access_count", "forgotten")
    return n.join(F.broadcast(t), "type_id", "left")


def _matched(s, d):
    n = _typed_nodes(s, d)
    alias = n.where("name is not null").select("graph_name", F.replace("name", F.lit("-"), F.lit(" ")).alias("alias"), F.col("id").alias("node_id"))
    return cut(store.match_nodes(cut(store.fold_delta(_delta(s, d))), n, alias)), n


def x4_matched(s, d):
    return _matched(s, d)[0].select("name", "node_id", "tier")


def x4_upserted(s, d):
    m, n = _matched(s, d)
    return store.upsert_nodes(n, m, AS_OF).groupBy("graph_name", "forgotten").agg(F.count("*").alias("n"), F.round(F.sum("importance"), 4).alias("importance"))


def x5_merge_safe(s, d):
    t = V.node_types(s, d).select("name")
    return t.select(F.col("name").alias("a")).crossJoin(F.broadcast(t.select(F.col("name").alias("b")))).select("a", "b", store.merge_safe(F.col("a"), F.col("b")).alias("safe")).where("safe and a <> b")


def x6_edges(s, d):
    key = ["graph_name", "source_id", "target_id", "type_id"]
    e = V.edges(s, d).where("source_id is not null and target_id is not null")
    old = e.groupBy(*key).agg(F.max("weight").alias("weight"))
    delta = e.where("weight >= 1.4").select("graph_name", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit(101).cast("bigint").alias("type_id"), F.lit(1.0).alias("weight"), F.col("id").alias("seq"))
    return store.upsert_edges(old, delta).groupBy("type_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 1).alias("weight"))


def x7_deleted(s, d):
    """Nodes below an importance go, with their edges: what is left per graph."""
    n = V.nodes(s, d, "graph_name", "importance")
    low = n.where("importance < 0.1").select("graph_name", "id")
    nodes = n.join(low, ["graph_name", "id"], "left_anti").groupBy("graph_name").agg(F.count("*").alias("n"))
    edges = graph.cascade_delete(V.edges(s, d), low).groupBy("graph_name").agg(F.count("*").alias("n_edges"))
    return nodes.join(edges, "graph_name", "left").select("graph_name", "n", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def x8_partial_update(s, d):
    c = table(s, d, "ontology_classes").select("class_id", "description").distinct().where("description is not null").groupBy(F.lower(F.regexp_extract("class_id", "^([a-z]+)_", 1)).alias("key")).agg(F.min("description").alias("new"))
    t = V.node_types(s, d)
    return t.join(F.broadcast(c), F.lower("name") == F.col("key"), "left").select("id", "name", F.coalesce("new", "description").alias("description"))


def x9_access(s, d):
    from .ordered import w10_first_three

    hit = w10_first_three(s, d).withColumn("hit", F.lit(1))
    n = V.nodes(s, d, "access_count", "last_accessed_at").join(hit, "id", "left")
    at = F.when(F.col("hit").isNotNull(), F.lit(AS_OF).cast("timestamp")).otherwise(F.col("last_accessed_at"))
    return n.select("id", (F.col("access_count") + F.coalesce("hit", F.lit(0))).cast("bigint").alias("access_count"), at.alias("last_accessed_at"))


def x10_forget(s, d):
    n = V.nodes(s, d, "forgotten", "forgotten_at", "importance")
    goes = ~F.col("forgotten") & (F.col("importance") < 0.2)
    return n.select("id", (F.col("forgotten") | goes).alias("forgotten"), F.when(goes, F.lit(AS_OF).cast("timestamp")).otherwise(F.col("forgotten_at")).alias("forgotten_at"))


def x11_forgettable(s, d):
    return store.forgettable(V.nodes(s, d, "forgotten", "importance", "access_count", "last_accessed_at", "created_at"), AS_OF)


def x12_consolidated(s, d):
    done = table(s, d, "ingest_results").where("status = 'stored' and episodes_created > 0").select(F.col("request_id").alias("id")).distinct().withColumn("c", F.lit(True))
    return V.episodes(s, d).join(done, "id", "left").select("id", F.coalesce("c", F.lit(False)).alias("consolidated"))


def x13_cleanup_partial(s, d):
    failed = table(s, d, "ingest_results").where("status = 'failed'").select(F.col("request_id").cast("string").alias("ep")).distinct()
    n = V.nodes(s, d, "properties", "graph_name").withColumn("ep", F.element_at("properties", "_source_episode"))
    e = table(s, d, "graph_edges").select("graph_name", "id", F.element_at("properties", "_source_episode").alias("ep")).distinct()
    left = [x.join(failed, "ep", "left_anti").groupBy("graph_name").agg(F.count("*").alias(c)) for x, c in ((n, "n"), (e, "n_edges"))]
    return left[0].join(left[1], "graph_name", "left").select("graph_name", "n", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def x14_types(s, d):
    from ..functions import text as T

    t = V.node_types(s, d).select("name")
    new = table(s, d, "ontology_classes").select(T.node_type_name(F.initcap(F.regexp_extract("class_id", "^([a-z]+)_", 1))).alias("name")).where("name is not null")
    return store.register(t, new, ["name"])


def x15_aliases(s, d):
    a = V.nodes(s, d, "name", "importance").where("name is not null")
    have = a.where("importance > 0.5").select(F.lower("name").alias("alias"), F.col("id").alias("node_id"))
    new = a.select(F.lower("name").alias("alias"), F.col("id").alias("node_id"))
    return store.register(have, new, ["alias", "node_id"])


def x16_retyped(s, d):
    n = V.nodes(s, d, "type_id")
    t = V.node_types(s, d).select(F.col("id").alias("known"))
    fixed = n.join(F.broadcast(t), F.col("type_id") == F.col("known"), "left").select(F.coalesce("known", F.lit(1).cast("bigint")).alias("type_id"))
    return fixed.groupBy("type_id").agg(F.count("*").alias("n"))


def x17_merged_types(s, d):
    n, t = store.merge_types(V.nodes(s, d, "type_id"), V.node_types(s, d))
    use = n.groupBy("type_id").agg(F.count("*").alias("n"))
    return t.join(F.broadcast(use), t["id"] == use["type_id"], "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def x18_archived(s, d):
    return store.unused_per_graph(V.node_types(s, d), V.nodes(s, d, "type_id", "graph_name"), store.SEED_NODE_TYPES, F.lit(AS_OF).cast("timestamp") - F.expr("interval 24 hours")).select("graph_name", "id", "name")


def x20_cleanup(s, d):
    e = V.edges(s, d)
    used = e.where("weight > 1.45").select("type_id")
    gone = store.unused_types(V.edge_types(s, d), used, store.SEED_EDGE_TYPES).select("id").withColumn("gone", F.lit(True))
    left = e.join(F.broadcast(gone.withColumnRenamed("id", "type_id")), "type_id", "left").select(F.when(F.col("gone"), F.lit(101).cast("bigint")).otherwise(F.col("type_id")).alias("type_id"))
    return left.groupBy("type_id").agg(F.count("*").alias("n"))


def x22_budget(s, d):
    from pyspark.sql import Window

    c = table(s, d, "ontology_classes").select("class_id", "label").distinct().withColumn("kind", F.regexp_extract("class_id", "^([a-z]+)_", 1))
    w = Window.partitionBy("kind").orderBy("class_id", "label")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 3").select("kind", "class_id")


def x23_new_domains(s, d):
    p = V.domains(s, d).select(F.col("id").alias("parent_id"), F.col("slug").alias("ps"), F.col("depth").alias("pd"), F.col("path").alias("pp")).where("pp is not null and pd is not null")
    return p.select("parent_id", F.concat("ps", F.lit("_new")).alias("slug"), (F.col("pd") + 1).cast("bigint").alias("depth"), F.concat_ws(".", "pp", F.concat("ps", F.lit("_new"))).alias("path"))


def x25_cancelled(s, d):
    j = V.jobs(s, d)
    out, ev = jobs.cancel(j, j.where("batch_no = 8").select("id"))
    return out.groupBy("status").agg(F.count("*").alias("n")).unionByName(ev.groupBy(F.concat(F.lit("event "), "type").alias("status")).agg(F.count("*").alias("n")))


def x25_retried(s, d):
    j = V.jobs(s, d)
    return jobs.retry(j, j.select("id")).select("id", "old_id", "status")


def _mentions(s, d):
    n = V.nodes(s, d, "properties", "name").select(F.lower("name").alias("entity"), F.col("id").alias("message"), F.explode("properties").alias("property", "value"))
    return n.where("entity is not null")


def x26_facts(s, d):
    return facts.facts_of(_mentions(s, d)).select("entity", "property", "value", "n_mentions", "first_message")


def x26_idempotent(s, d):
    f = facts.facts_of(_mentions(s, d))
    return facts.apply_facts(f, f).agg(F.count("*").alias("n_facts"), F.countDistinct("fact").alias("n_different"))


def x28_conflicts(s, d):
    return facts.conflicts(facts.facts_of(_mentions(s, d)))


def x3_embedding(s, d):
    n = V.nodes(s, d, "embedding")
    """Nodes without a usable embedding get one of the delivered vectors, taken in turn; what they then have is told by its length and first number."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("new"))
    ok = F.size(F.coalesce("embedding", F.array().cast("array<float>"))) == 64
    turn = n.crossJoin(F.broadcast(e.agg(F.count("*").alias("many")))).withColumn("v", F.when(~ok, F.col("id") % F.col("many")))
    now = store.set_embedding(turn, turn.join(e, "v").select("id", "new"))
    return now.select("id", F.size(F.coalesce("embedding", F.array().cast("array<float>"))).cast("bigint").alias("n"), F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 4).alias("head"))


def n7_reinforced(s, d):
    e = V.edges(s, d).where("weight is not null")
    return store.reinforce(e, e.where("type_id = 101").select("graph_name", "id")).groupBy("graph_name").agg(F.round(F.sum("weight"), 1).alias("weight"))


QUERIES = {k: f for k, f in list(globals().items()) if (k[0] == "x" and k[1:2].isdigit()) or k == "n7_reinforced"}
_MEN = """, pr as (select lower(name) as entity, id as message, unnest(map_entries(properties)) as kv from n where name is not null),
  mn as (select entity, message, kv.key as property, kv.value as value, coalesce(cast(try_cast(kv.value as double) as varchar), trim(kv.value)) as norm from pr where kv.value is not null),
  ft as (select entity, property, norm, min(trim(value)) as value, count(distinct message) as n_mentions, min(message) as first_message from mn group by 1, 2, 3)"""
_GROUPS = " union all ".join(f"select {i} as g, unnest([{', '.join(repr(x.lower()) for x in g.split())}]) as t" for i, g in enumerate(store.MERGE_SAFE))


def _safe_sql(a: str, b: str) -> str:
    group = f"exists (select 1 from gr x join gr y on x.g = y.g where x.t = lower({a}) and y.t = lower({b}))"
    never = " or ".join("({0} in {2} and {1} in {2})".format(a, b, tuple(p.split())) for p in store.HOMONYMS)
    return f"({a} = {b} or (not ({never}) and ({group} or starts_with(lower({a}), lower({b})) or starts_with(lower({b}), lower({a})))))"


_X4 = f""", gr as ({_GROUPS}), dl as (select label as name, class_id as seq, upper(string_split(label, ' ')[1][1]) || lower(string_split(label, ' ')[1][2:]) as type_name, description as content from (select distinct * from ontology_classes) where label is not null), {canonical_sql("dl")},
  fd as (select lower(canonical) as key, max_by(canonical, seq) as name, max_by(type_name, seq) as type_name, max_by(content, seq) filter (where content is not null) as content from canon where canonical <> '' group by 1),
  nn as (select n.id, lower(n.name) as nkey, lower(replace(n.name, '-', ' ')) as alias, nt.name as ntype from n left join nt on nt.id = n.type_id where n.name is not null and graph_name = 'ncx_shared__work_context'),
  known as (select key, type_name, nn.id, ntype, 1 as tier, 1.0::double as sim from fd join nn on nkey = key union all select key, type_name, nn.id, ntype, 2, 1.0 from fd join nn on alias = key),
  fz as (select key, type_name, nn.id, ntype, 3 as tier, {tri_sim('key', 'nkey')} as sim from fd cross join nn where key not in (select key from known)),
  al as (select * from known union all select * from fz where sim >= 0.3),
  ok as (select * from al where type_name is null or ntype is null or {_safe_sql('ntype', 'type_name')}),
  bt as (select key, id as node_id, tier from (select *, row_number() over (partition by key order by tier, sim desc, coalesce(ntype = type_name, false) desc, id) as r from ok) where r = 1),
  mt as (select fd.*, node_id, tier from fd left join bt using (key))
"""
SQL = {
    "x4_matched": sql("n nt", _X4 + "select name, node_id, tier from mt"),
    "x4_upserted": sql("n nt", _X4 + """, h as (select node_id from mt where node_id is not null group by 1), r as (
      select graph_name, forgotten and h.node_id is null as forgotten, case when h.node_id is null then importance else greatest(importance, 0.6) end as importance from n left join h on h.node_id = n.id
      union all select 'ncx_shared__work_context', false, 0.6 from mt where node_id is null) select graph_name, forgotten, count(*) as n, round(sum(importance), 4) as importance from r group by 1, 2"""),
    "x2_ingest": sql("ep", """, h as (select *, sha256(content) as hash from ep), hist as (select agent_id, hash, min(id) as old from h where batch_no = 0 and hash is not null group by 1, 2),
      b as (select *, min(id) over (partition by agent_id, hash) as first from h where batch_no >= 1), x as (select b.id, content, force_flag, coalesce(old, case when first < b.id and content is not null then first end) as old from b left join hist on hist.agent_id is not distinct from b.agent_id and hist.hash = b.hash)
      select id, case when content is null then 'failed' when coalesce(force_flag, false) then 'stored' when old is not null then 'skipped' else 'stored' end as status, case when content is not null and not coalesce(force_flag, false) then old end as existing_id from x"""),
    "x5_merge_safe": f"""with g as ({_GROUPS}), p as (select a.name as a, b.name as b from graph_node_types a, graph_node_types b where a.name <> b.name)
      select a, b, true as safe from p where not (a in ('Person', 'Organization') and b in ('Person', 'Organization'))
      and (exists (select 1 from g x join g y on x.g = y.g where x.t = lower(a) and y.t = lower(b)) or starts_with(lower(a), lower(b)) or starts_with(lower(b), lower(a)))""",
    "x6_edges": sql("e", """, f as (select * from e where source_id is not null and target_id is not null), o as (select graph_name, source_id, target_id, type_id, max(weight) as weight from f group by 1, 2, 3, 4),
      dl as (select graph_name, target_id as source_id, source_id as target_id, 101 as type_id, 1.0::double as weight from f where weight >= 1.4 group by all),
      pn as (select graph_name, source_id, target_id from o group by 1, 2, 3 having count(*) = 1),
      pr as (select dl.* from dl join pn using (graph_name, source_id, target_id)), rs as (select * from dl where not exists (select 1 from pr where pr.graph_name = dl.graph_name and pr.source_id = dl.source_id and pr.target_id = dl.target_id)),
      o2 as (select o.graph_name, o.source_id, o.target_id, coalesce(pr.type_id, o.type_id) as type_id, coalesce(pr.weight, o.weight) as weight from o left join pr using (graph_name, source_id, target_id)),
      r as (select coalesce(o2.type_id, rs.type_id) as type_id, coalesce(rs.weight, o2.weight) as weight from o2 full join rs on o2.graph_name = rs.graph_name and o2.source_id = rs.source_id and o2.target_id = rs.target_id and o2.type_id = rs.type_id)
      select type_id, count(*) as n, round(sum(weight), 1) as weight from r group by 1"""),
    "x7_deleted": sql("n e", """, g as (select graph_name, id from n where importance < 0.1), a as (select graph_name, count(*) as n from n where importance >= 0.1 group by 1),
      b as (select graph_name, count(*) as n_edges from e where not exists (select 1 from g where g.graph_name = e.graph_name and (g.id = e.source_id or g.id = e.target_id)) group by 1) select a.*, coalesce(n_edges, 0) as n_edges from a left join b using (graph_name)"""),
    "x8_partial_update": "with c as (select regexp_extract(class_id, '^([a-z]+)_', 1) as key, min(description) as new from ontology_classes where description is not null group by 1) select id, name, coalesce(new, description) as description from graph_node_types left join c on key = lower(name)",
    "x9_access": sql("n", ", h as (select id from (select id, row_number() over (partition by graph_name order by importance desc, id) as r from n where graph_name is not null) where r <= 3) select id, cast(access_count + case when id in (select id from h) then 1 else 0 end as bigint) as access_count, case when id in (select id from h) then timestamp '2025-12-01 00:00:00' else last_accessed_at end as last_accessed_at from n"),
    "x10_forget": sql("n", f"select id, forgotten or importance < 0.2 as forgotten, case when not forgotten and importance < 0.2 then timestamp '{AS_OF}' else forgotten_at end as forgotten_at from n"),
    "x11_forgettable": sql("n", f"select id from n where not forgotten and importance < 0.3 and access_count = 0 and coalesce(last_accessed_at, created_at) < timestamp '{AS_OF}' - interval 7 days"),
    "x12_consolidated": sql("ep", "select id, id in (select request_id from ingest_results where status = 'stored' and episodes_created > 0) as consolidated from ep"),
    "x13_cleanup_partial": sql("n", """, f as (select cast(request_id as varchar) as x from ingest_results where status = 'failed'), a as (select graph_name, count(*) as n from n where coalesce(properties['_source_episode'], '') not in (select x from f) group by 1),
      b as (select graph_name, count(*) as n_edges from (select distinct graph_name, id, properties['_source_episode'] as ep from graph_edges) where coalesce(ep, '') not in (select x from f) group by 1) select a.*, coalesce(n_edges, 0) as n_edges from a left join b using (graph_name)"""),
    "x14_types": "select name from graph_node_types union select upper(left(k, 1)) || substring(k, 2) from (select distinct regexp_extract(class_id, '^([a-z]+)_', 1) as k from ontology_classes) where length(k) >= 2",
    "x15_aliases": sql("n", "select lower(name) as alias, id as node_id from n where name is not null"),
    "x16_retyped": sql("n nt", "select coalesce(nt.id, 1) as type_id, count(*) as n from n left join nt on nt.id = n.type_id group by 1"),
    "x17_merged_types": sql("n nt", ", m as (select a.id as src, b.id as dst from nt a, nt b where (a.name, b.name) in (" + ", ".join(f"('{x}', '{y}')" for x, y in store.TYPE_MERGES.items()) + ")), u as (select coalesce(dst, type_id) as t, count(*) as n from n left join m on src = type_id group by 1) select name, coalesce(u.n, 0) as n from nt left join u on u.t = nt.id where nt.id not in (select src from m)"),
    "x18_archived": sql("n nt", f", gs as (select distinct graph_name from n where graph_name is not null) select graph_name, id, name from gs, nt where name not in ({', '.join(repr(x) for x in store.SEED_NODE_TYPES)}) and created_at < timestamp '{AS_OF}' - interval 24 hours and id not in (select type_id from n where n.graph_name = gs.graph_name and type_id is not null)"),
    "x20_cleanup": sql("e et", f", g as (select id from et where name not in ({', '.join(repr(x) for x in store.SEED_EDGE_TYPES)}) and id not in (select type_id from e where weight > 1.45 and type_id is not null)) select case when type_id in (select id from g) then 101 else type_id end as type_id, count(*) as n from e group by 1"),
    "x22_budget": "select kind, class_id from (select kind, class_id, row_number() over (partition by kind order by class_id, label) as r from (select distinct class_id, label, regexp_extract(class_id, '^([a-z]+)_', 1) as kind from ontology_classes)) where r <= 3",
    "x23_new_domains": sql("dom", "select id as parent_id, slug || '_new' as slug, cast(depth + 1 as bigint) as depth, path || '.' || slug || '_new' as path from dom where path is not null and depth is not null"),
    "x25_cancelled": sql("ep jb", ", x as (select case when status = 'todo' and batch_no = 8 then 'cancelled' else status end as status, status = 'todo' and batch_no = 8 as hit from jb) select status, count(*) as n from x group by 1 union all select 'event cancelled', count(*) from x where hit having count(*) > 0"),
    "x25_retried": sql("ep jb", "select (select max(id) from jb) + row_number() over (order by id) as id, id as old_id, 'todo' as status from jb where status in ('failed', 'cancelled')"),
    "x26_facts": sql("n", _MEN + "select entity, property, value, n_mentions, first_message from ft"),
    "x26_idempotent": sql("n", _MEN + "select count(*) as n_facts, count(*) as n_different from ft"),
    "x28_conflicts": sql("n", _MEN + "select entity, property, count(*) as n_values from ft group by 1, 2 having count(*) > 1"),
    "x3_embedding": sql("n", ", x as (select n.id, case when coalesce(len(n.embedding), 0) = 64 then n.embedding else coalesce(v.embedding, n.embedding) end as e from n left join embeddings v on v.vec_id = n.id % (select count(*) from embeddings)) select id, coalesce(len(e), 0) as n, round(e[1]::double, 4) as head from x"),
    "n7_reinforced": sql("e", "select graph_name, round(sum(case when type_id = 101 then least(weight + case when 1 + (weight - 1) * 5 > 1e-9 then 0.05::double / (1 + (weight - 1) * 5) else 0.05::double end, 1.5) else weight end), 1) as weight from e where weight is not null group by 1"),
}
