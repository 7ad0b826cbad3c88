"""What the reference's tools and services return, composed from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import scoring as S
from ..functions import text as T
from ..operators import graph as G
from ..operators import facts, ingest, sessions, store
from ..runtime import cut, shared_dir, table
from ..sources import files, snapshots
from ..views import AS_OF, sql
from .access import permissions, registry
from .filters import tri_sim
from .scalars import REC


def s14_manifest(s, d):
    steps = V.node_types(s, d).select("name", F.coalesce("description", F.lit("")).alias("body"))
    applied = snapshots.manifest(steps.where("body <> ''")).withColumn("checksum", F.when(F.length("name") > 8, F.lit("old")).otherwise(F.col("checksum")))
    return snapshots.pending(steps, applied)


def s16_health(s, d):
    h = snapshots.health(s, [f"{d}/{t}.parquet" for t in ("graph_nodes", "graph_edges", "no_such_table")])
    return h.select(F.regexp_extract("table", r"([a-z_]+)\.parquet$", 1).alias("table"), "readable")


def s18_snapshot(s, d):
    import uuid

    name = f"s{uuid.uuid4().hex}"
    snapshots.save({"types": V.node_types(s, d)}, f"{shared_dir(s)}/snapshots", name)
    return snapshots.load(s, f"{shared_dir(s)}/snapshots", name, "types").select("id", "name")


def s20_audit(s, d):
    import uuid

    path = f"{shared_dir(s)}/audit-{uuid.uuid4().hex}"
    files.write_audit(V.episodes(s, d).select("id", "agent_id", F.lit("remember").alias("action")), path)
    return files.read_audit(s, path, "id bigint, agent_id string, action string").groupBy("agent_id", "action").agg(F.count("*").alias("n"))


def m7_neighbour_score(s, d):
    e = V.event_episodes(s, d)
    best = e.withColumn("score", S.recency(F.col("created_at"), "2024-02-01 00:00:00")).orderBy(F.desc("created_at"), F.desc("id")).limit(20)
    near = sessions.neighbours(e, best.select("id"), 3).join(best.select("id", "score"), "id")
    return near.groupBy("neighbour_id").agg(F.round(F.max("score") * S.NEIGHBOUR_FACTOR, 6).alias("score"))


def m12_rounded(s, d):
    return V.nodes(s, d, "importance").select("id", F.round("importance", 1).alias("importance"))


def t7_like_escape(s, d):
    e = F.regexp_replace("name", r"([\\%_])", r"\\$1")
    return V.edge_types(s, d).select("id", e.alias("escaped"), F.like("name", e).alias("matches_itself"))


def t18_decoded(s, d):
    raw = F.encode(F.col("name"), "UTF-8")
    return V.nodes(s, d, "name").where("name is not null").select("id", F.decode(raw, "UTF-8").alias("name"), F.octet_length("name").cast("bigint").alias("n_bytes"))


def d4_running(s, d):
    j = V.jobs(s, d).where("status = 'todo' and scheduled_at is not null")
    return j.select("id", F.round((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("scheduled_at")) / F.lit(3.6e9), 4).alias("hours"))


def pj4_enriched(s, d):
    m = table(s, d, "ingest_requests").select("request_id", "metadata", "force_flag").where("metadata is not null")
    more = F.map_zip_with("metadata", F.create_map(F.lit("importance_hint"), F.when(F.col("force_flag"), "0.9").otherwise("0.5")), lambda k, a, b: F.coalesce(b, a))
    return m.select("request_id", F.element_at(more, "importance_hint").alias("hint"), F.size(more).cast("bigint").alias("n_keys")).distinct()


def pj5_context(s, d):
    adj = G.both_ways(V.edges(s, d)).groupBy("graph_name", "node").agg(F.sort_array(F.collect_set(F.struct("nbr"))).alias("x"))
    n = V.nodes(s, d, "graph_name", "name")
    return n.join(adj.withColumnRenamed("node", "id"), ["graph_name", "id"], "left").select("id", F.coalesce(F.size("x"), F.lit(0)).cast("bigint").alias("n_neighbours"), F.try_element_at("x", F.lit(1))["nbr"].alias("first_neighbour"))


def g15_drift(s, d):
    """Graphs with nodes of at least three types none of whose words occur in the graph's purpose."""
    t = V.node_types(s, d).select(F.col("id").alias("type_id"), F.lower("name").alias("t"))
    n = V.nodes(s, d, "graph_name", "type_id", "forgotten").where("not forgotten and graph_name is not null").join(F.broadcast(t), "type_id")
    per = n.groupBy("graph_name").agg(F.collect_set("t").alias("types"))
    words = F.split(F.regexp_replace(T.purpose(F.col("graph_name")), "_", " "), " ")
    return per.where(F.size("types") >= 3).where(~F.arrays_overlap("types", words)).select("graph_name", F.size("types").cast("bigint").alias("n_types"))


def q8_agent_search(s, d):
    q = T.tokens(F.lit("notebook schedule"))
    e = V.episodes(s, d).where("agent_id = 'agent_atlas' and content is not null")
    return e.select("id", F.round(T.text_rank(T.tokens(F.col("content")), q), 6).alias("rank")).where("rank > 0").orderBy(F.desc("rank"), "id").limit(20)


def q14_discover(s, d):
    n = V.nodes(s, d, "graph_name", "forgotten", "type_id").where("not forgotten").groupBy("graph_name").agg(F.count("*").alias("n_nodes"), F.countDistinct("type_id").alias("n_types"))
    p = permissions(s, d).where("can_read").groupBy("graph_name").agg(F.count("*").alias("n_readers"))
    return registry(s, d).join(n, "graph_name", "left").join(p, "graph_name", "left").select("graph_name", "purpose", "is_shared", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_types", F.lit(0)).alias("n_types"), F.coalesce("n_readers", F.lit(0)).alias("n_readers"))


def q23_existing(s, d):
    n = V.nodes(s, d, "name", "content", "forgotten").where("not forgotten and name is not null")
    hit = n.select("id", "name", F.round(T.trigram_similarity(F.col("name"), F.lit("Weekly Databse")), 3).alias("score"), F.substring("content", 1, 100).alias("excerpt"))
    return hit.orderBy(F.desc("score"), "id").limit(5)


def q24_type_context(s, d):
    from .ordered import examples_per_type

    ex = examples_per_type(V.nodes(s, d, "type_id", "name", "importance", "forgotten"), 5).groupBy("type_id").agg(F.count("*").alias("n"))
    return ex.join(F.broadcast(V.node_types(s, d).select(F.col("id").alias("type_id"), "name")), "type_id").orderBy("name").limit(20).select("name", "n")


def q25_known_names(s, d):
    return V.nodes(s, d, "name", "forgotten").where("not forgotten and name is not null").select("name").distinct().orderBy("name").limit(500)


def x1_append(s, d):
    """Batch 8 appended to what came before, with session numbers that go on."""
    e = V.episodes(s, d).select("id", "agent_id", "session_id", "created_at", "batch_no")
    old, new = e.where("batch_no < 8"), e.where("batch_no = 8")
    last = old.where("session_id is not null").groupBy("agent_id", "session_id").agg(F.count("*").alias("last"))
    num = sessions.with_sequence(new).join(last, ["agent_id", "session_id"], "left")
    return num.select("id", (F.col("session_sequence") + F.coalesce("last", F.lit(0))).alias("session_sequence"))


def x19_empty_types(s, d):
    old = F.lit("2025-07-01 00:00:00").cast("timestamp")
    used = V.nodes(s, d, "type_id", "forgotten", "graph_name").where("not forgotten")
    return store.unused_per_graph(V.node_types(s, d), used, [], old).select("graph_name", "id")


def x21_persisted(s, d):
    """Classes with their parent as a payload: endpoints found by name in the payload first, then in the graph; edges without both are left out."""
    c = table(s, d, "ontology_classes").select("class_id", F.col("parent_class_id").alias("p")).distinct().where("class_id is not null")
    known = c.select(F.col("class_id").alias("p"), F.lit("payload").alias("found")).distinct()
    graph = V.nodes(s, d, "name").where("name is not null").select(F.lower("name").alias("p"), F.lit("graph").alias("found2")).distinct()
    e = c.where("p is not null and p <> ''").join(known, "p", "left").join(graph, "p", "left")
    return e.groupBy(F.coalesce("found", "found2", F.lit("missing")).alias("endpoint")).agg(F.count("*").alias("n"))


def x24_registry(s, d):
    have = registry(s, d).select("graph_name")
    new = table(s, d, "ingest_requests").where("agent_id is not null").select(T.schema_name(F.regexp_replace("agent_id", "^agent_", ""), F.lit("personal")).alias("graph_name")).distinct()
    return store.register(have, new, ["graph_name"]).select("graph_name", F.regexp_extract("graph_name", "__(.*)$", 1).alias("purpose"))


def x27_signature(s, d):
    v = F.element_at("properties", "confidence")
    n = V.nodes(s, d, "properties").where(v.isNotNull())
    return n.select("id", facts.signature(F.col("id"), F.lit("confidence"), v).alias("signature"))


def x29_readers(s, d):
    c = table(s, d, "ontology_classes").distinct()
    return c.where("label is not null").select("class_id", F.lower("label").alias("label"), F.coalesce("parent_class_id", F.lit("")).alias("parent")).distinct()


def x30_upserted_flag(s, d):
    return V.nodes(s, d, "created_at").select("id", F.coalesce(F.col("created_at") == F.col("updated_at"), F.lit(False)).alias("is_new"))


def x31_edges_by_name(s, d):
    """Edges asked for by names: found, or which end is missing."""
    n = V.nodes(s, d, "name", "graph_name").where("name is not null and graph_name = 'ncx_shared__work_context'").groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("i"))
    asked = table(s, d, "semantic_domains").select("id", F.lower("name").alias("a"), F.lower(F.replace("name", F.lit(" "), F.lit("-"))).alias("b")).where("a is not null").distinct()
    x = asked.join(n.select(F.col("k").alias("a"), F.col("i").alias("ia")), "a", "left").join(n.select(F.col("k").alias("b"), F.col("i").alias("ib")), "b", "left")
    state = F.when(F.col("ia").isNull(), "source missing").when(F.col("ib").isNull(), "target missing").otherwise("found")
    return x.select(state.alias("state"), "id").distinct().groupBy("state").agg(F.count("*").alias("n"))


def x32_archived(s, d):
    n = V.nodes(s, d, "graph_name", "forgotten", "importance")
    gone = n.where("importance < 0.05")
    left = G.cascade_delete(V.edges(s, d), gone.select("graph_name", "id"))
    return left.agg(F.count("*").alias("n_edges")).crossJoin(F.broadcast(gone.agg(F.count("*").alias("n_archived"))))


def k7_maintenance(s, d):
    """What a round of upkeep would touch: decayed edges, forgettable nodes, empty types."""
    e = V.edges(s, d).where("weight > 0.1").where(F.col("last_reinforced_at") < F.lit(AS_OF).cast("timestamp") - F.expr("interval 48 hours"))
    n = store.forgettable(V.nodes(s, d, "forgotten", "importance", "access_count", "last_accessed_at", "created_at"), AS_OF)
    t = store.unused_types(V.node_types(s, d), V.nodes(s, d, "type_id").select("type_id"), store.SEED_NODE_TYPES)
    out = None
    for name, df in (("stale edges", e), ("forgettable nodes", n), ("empty types", t)):
        x = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("task"), "n")
        out = x if out is None else out.unionByName(x)
    return out


def x2_status(s, d):
    """Per batch: how many requests were stored, skipped and failed, and the status of the whole."""
    e = V.episodes(s, d).select("id", "agent_id", "content", F.col("force_flag").alias("force"), "batch_no")
    hist = e.where("batch_no = 0 and content is not null").select("agent_id", F.sha2("content", 256).alias("content_hash"), "id")
    r = ingest.dedup_batch(e.where("batch_no >= 1"), cut(hist)).join(e.select("id", "batch_no"), "id")
    g = r.groupBy("batch_no").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("stored", "skipped", "failed")])
    return g.withColumn("state", F.when(F.col("skipped") == 0, "stored").when(F.col("stored") == 0, "skipped").otherwise("partial"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and "_" in k and any(c.isdigit() for c in k.split("_")[0])}
_REG = """rg as (select graph_name, regexp_extract(graph_name, '__(.*)$', 1) as purpose, regexp_extract(graph_name, '^ncx_(.*?)__', 1) = 'shared' as is_shared from (select distinct graph_name from n where graph_name is not null))"""
SQL = {
    "s14_manifest": "select name, case when description is null then 'new' when length(name) > 8 then 'changed' end as state from graph_node_types where description is null or length(name) > 8",
    "s16_health": "select unnest(['graph_nodes', 'graph_edges', 'no_such_table']) as \"table\", unnest([true, true, false]) as readable",
    "s18_snapshot": "select id, name from graph_node_types",
    "s20_audit": sql("ep", "select agent_id, 'remember' as action, count(*) as n from ep group by 1"),
    "m7_neighbour_score": sql("ev", f""", sq as (select *, row_number() over (partition by agent_id, session_id order by created_at, id) as sqn from ev),
      top as (select *, {REC.format('created_at').replace(AS_OF, '2024-02-01 00:00:00')} as score from sq order by created_at desc, id desc limit 20)
      select b.id as neighbour_id, round(max(a.score) * 0.6, 6) as score from top a join sq b on a.agent_id is not distinct from b.agent_id and a.session_id = b.session_id and b.sqn between a.sqn - 1 and a.sqn + 2 and a.id <> b.id group by 1"""),
    "m12_rounded": sql("n", "select id, round(importance, 1) as importance from n"),
    "t7_like_escape": r"select id, regexp_replace(name, '([\\%_])', '\\\1', 'g') as escaped, true as matches_itself from graph_edge_types",
    "t18_decoded": sql("n", "select id, name, octet_length(encode(name)) as n_bytes from n where name is not null"),
    "d4_running": sql("ep jb", f"select id, round((epoch_us(timestamp '{AS_OF}') - epoch_us(scheduled_at)) / 3.6e9::double, 4) as hours from jb where status = 'todo' and scheduled_at is not null"),
    "pj4_enriched": "select distinct request_id, case when force_flag then '0.9' else '0.5' end as hint, cast(len(list_filter(map_keys(metadata), lambda k: k <> 'importance_hint')) + 1 as bigint) as n_keys from ingest_requests where metadata is not null",
    "pj5_context": sql("n e", """, f as (select * from e where source_id is not null and target_id is not null), adj as (select graph_name, source_id as a, target_id as b from f union select graph_name, target_id, source_id from f)
      select n.id, count(b) as n_neighbours, min(b) as first_neighbour from n left join adj on adj.graph_name = n.graph_name and a = n.id group by 1"""),
    "g15_drift": sql("n nt", """, x as (select graph_name, list(distinct lower(nt.name)) as ts from n join nt on nt.id = n.type_id where not forgotten and graph_name is not null group by 1)
      select graph_name, cast(len(ts) as bigint) as n_types from x where len(ts) >= 3 and not list_has_any(ts, string_split(replace(regexp_extract(graph_name, '__(.*)$', 1), '_', ' '), ' '))"""),
    "q8_agent_search": sql("ep", """, x as (select id, len(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda w: w in ('notebook', 'schedule')))::double as tf from ep where agent_id = 'agent_atlas' and content is not null)
      select id, round(tf / (tf + 1), 6) as rank from x where tf > 0 order by rank desc, id limit 20"""),
    "q14_discover": sql("n", f""", {_REG}, a as (select graph_name, count(*) as n_nodes, count(distinct type_id) as n_types from n where not forgotten group by 1), p as (select target_graph as g, count(distinct agent_id) as n_readers from ingest_requests where target_graph is not null and agent_id is not null group by 1)
      select rg.*, coalesce(n_nodes, 0) as n_nodes, coalesce(n_types, 0) as n_types, coalesce(n_readers, 0) as n_readers from rg left join a on a.graph_name = rg.graph_name left join p on p.g = rg.graph_name"""),
    "q23_existing": sql("n", f", x as (select id, name, round({tri_sim('name', chr(39) + 'Weekly Databse' + chr(39))}, 3) as score, left(content, 100) as excerpt from n where not forgotten and name is not null) select * from x order by score desc, id limit 5"),
    "q24_type_context": sql("n nt", ", x as (select type_id, least(count(*), 5) as n from n where not forgotten and name is not null and type_id is not null group by 1) select nt.name, x.n from x join nt on nt.id = x.type_id order by nt.name limit 20"),
    "q25_known_names": sql("n", "select distinct name from n where not forgotten and name is not null order by name limit 500"),
    "x1_append": sql("ep", """, o as (select agent_id, session_id, count(*) as last from ep where batch_no < 8 and session_id is not null group by 1, 2),
      w as (select *, row_number() over (partition by agent_id, session_id order by created_at, id) as r from ep where batch_no = 8)
      select id, case when w.session_id is not null then r + coalesce(last, 0) end as session_sequence from w left join o on o.agent_id = w.agent_id and o.session_id = w.session_id"""),
    "x19_empty_types": sql("n nt", ", gs as (select distinct graph_name from n where not forgotten and graph_name is not null) select graph_name, id from gs, nt where created_at < timestamp '2025-07-01' and id not in (select type_id from n where not forgotten and n.graph_name = gs.graph_name and type_id is not null)"),
    "x21_persisted": sql("n", """, c as (select distinct class_id, parent_class_id as p from ontology_classes where class_id is not null)
      select case when p in (select class_id from c) then 'payload' when p in (select lower(name) from n where name is not null) then 'graph' else 'missing' end as endpoint, count(*) as n from c where p is not null and p <> '' group by 1"""),
    "x24_registry": sql("n", ", x as (select distinct graph_name from n where graph_name is not null union select distinct 'ncx_' || trim(regexp_replace(lower(trim(regexp_replace(agent_id, '^agent_', ''))), '[^a-z0-9]+', '_', 'g'), '_') || '__personal' from ingest_requests where agent_id is not null) select graph_name, regexp_extract(graph_name, '__(.*)$', 1) as purpose from x"),
    "x27_signature": sql("n", "select id, sha256(id || chr(31) || 'confidence' || chr(31) || coalesce(cast(try_cast(properties['confidence'] as double) as varchar), trim(properties['confidence']))) as signature from n where properties['confidence'] is not null"),
    "x29_readers": "select distinct class_id, lower(label) as label, coalesce(parent_class_id, '') as parent from ontology_classes where label is not null",
    "x30_upserted_flag": sql("n", "select id, coalesce(created_at = updated_at, false) as is_new from n"),
    "x31_edges_by_name": sql("n", """, k as (select lower(name) as k from n where name is not null and graph_name = 'ncx_shared__work_context'), a as (select distinct id, lower(name) as a, lower(replace(name, ' ', '-')) as b from semantic_domains where name is not null),
      x as (select distinct id, case when a not in (select k from k) then 'source missing' when b not in (select k from k) then 'target missing' else 'found' end as state from a) select state, count(*) as n from x group by 1"""),
    "x32_archived": sql("n e", ", g as (select graph_name, id from n where importance < 0.05) select (select count(*) from e where not exists (select 1 from g where g.graph_name = e.graph_name and (g.id = e.source_id or g.id = e.target_id))) as n_edges, (select count(*) from g) as n_archived"),
    "k7_maintenance": sql("n e nt", f"""select 'stale edges' as task, count(*) as n from e where weight > 0.1 and last_reinforced_at < timestamp '{AS_OF}' - interval 48 hours
      union all select 'forgettable nodes', count(*) from n where not forgotten and importance < 0.3 and access_count = 0 and coalesce(last_accessed_at, created_at) < timestamp '{AS_OF}' - interval 7 days
      union all select 'empty types', count(*) from nt where name not in ({', '.join(repr(x) for x in store.SEED_NODE_TYPES)}) and id not in (select type_id from n where type_id is not null)"""),
    "x2_status": sql("ep", """, h as (select *, sha256(content) as hash from ep), hist as (select distinct agent_id, hash from h where batch_no = 0 and hash is not null),
      b as (select *, min(id) over (partition by agent_id, hash) as first from h where batch_no >= 1),
      x as (select batch_no, case when content is null then 'failed' when coalesce(force_flag, false) then 'stored' when exists (select 1 from hist where hist.agent_id is not distinct from b.agent_id and hist.hash = b.hash) or first < id then 'skipped' else 'stored' end as status from b),
      g as (select batch_no, count(*) filter (where status = 'stored') as stored, count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'failed') as failed from x group by 1)
      select *, case when skipped = 0 then 'stored' when stored = 0 then 'skipped' else 'partial' end as state from g"""),
}
