"""Operations that take several operators, and those a plan used only inside another query so far."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as T
from ..operators import facts, graph, jobs, permissions, retrieval, routing, store
from ..runtime import cut, shared_dir, table
from ..sources import files, snapshots
from ..streaming import pipelines as P
from ..views import AS_OF, sql
from . import access
from .changes import _MEN, _mentions


def t16_lock_key(s, d):
    return V.nodes(s, d, "name").where("name is not null").select("id", T.lock_key(F.col("name")).alias("lock_key"))


def s8_media(s, d):
    """Uploads by kind: the documents stand for uploads, their format and size for type and bytes."""
    mime = F.when(F.col("doc_format") == "transcript", "Audio/MPEG; rate=8000").when(F.col("doc_format") == "events", "video/mp4").otherwise(F.concat(F.lit("text/"), "doc_format"))
    return table(s, d, "documents").select("doc_id", files.media_kind(mime, F.col("n_chars") * 40000).alias("kind"))


def s10_blob_paths(s, d):
    docs = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("../"), "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("a/"), "doc_id", F.lit(".ogg"))).alias("name"))
    return docs.select("doc_id", files.blob_path("/media", F.col("name")).alias("path"))


def s18_listed(s, d):
    """Two snapshots are saved, one is deleted: what the list then holds."""
    import uuid

    root = f"{shared_dir(s)}/snap-{uuid.uuid4().hex}"
    for name in ("a", "b"):
        snapshots.save({"types": V.edge_types(s, d)}, root, name)
    snapshots.delete(s, root, "a")
    return s.createDataFrame([(n,) for n in snapshots.names(s, root)], "name string")


def j17_labels(s, d):
    """Every edge with the names of its type and of its source's type, looked up in the two type lists."""
    et, nt = V.edge_types(s, d).select(F.col("id").alias("type_id"), F.col("name").alias("rel")), V.node_types(s, d).select(F.col("id").alias("nt"), F.col("name").alias("kind"))
    n = V.nodes(s, d, "type_id", "graph_name").select("graph_name", F.col("id").alias("source_id"), F.col("type_id").alias("nt")).join(F.broadcast(nt), "nt", "left")
    e = V.edges(s, d).join(F.broadcast(et), "type_id", "left").join(n, ["graph_name", "source_id"], "left")
    return e.groupBy(F.coalesce("rel", F.lit("?")).alias("rel"), F.coalesce("kind", F.lit("Untyped")).alias("kind")).agg(F.count("*").alias("n"))


def n6_superseded(s, d):
    return graph.supersession_flags(V.edges(s, d), V.edge_types(s, d))


def n8_request_links(s, d):
    """FOLLOWS links over the sessions of the requests."""
    from .graphs import _first_nodes

    return graph.session_links(V.episodes(s, d), _first_nodes(s, d)).select("source_id", "target_id", "weight")


def w9_first_discovery(s, d):
    """The edge that first reached each node from the nodes of one graph."""
    seeds = V.nodes(s, d, "graph_name").where("graph_name = 'ncx_shared__work_context'").select("graph_name", "id")
    return graph.neighbourhood(seeds, V.edges(s, d), 2).select("seed", "node", "distance", "edge_id")


def _found(s, d):
    n = V.nodes(s, d, "name", "graph_name", "importance", "forgotten").where("not forgotten and name is not null and graph_name is not null")
    return n.where(T.contains_ci(F.col("name"), F.lit("engine"))).select(F.lit("node").alias("kind"), "id", "graph_name", F.round("importance", 1).alias("score"))


def o8_tie_break(s, d):
    """Nodes and episodes of one list with coarse scores: equal scores put nodes first, then the smaller id."""
    eps = V.episodes(s, d).where(T.contains_ci(F.col("content"), F.lit("spare wheel"))).select(F.lit("episode").alias("kind"), "id", "graph_name", F.lit(0.5).alias("score"))
    return retrieval.ranked(_found(s, d).unionByName(eps), 60).select("kind", "id", "score")


def u3_fan_out(s, d):
    """The three best hits of every graph in one scan."""
    w = Window.partitionBy("graph_name").orderBy(F.desc("score"), "id")
    return _found(s, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("graph_name", "id", "score")


def u5_type_sets(s, d):
    """Common and united node types of two graphs of one owner."""
    n = V.nodes(s, d, "graph_name", "type_id").where("graph_name is not null and type_id is not null")
    per = n.groupBy("graph_name").agg(F.collect_set("type_id").alias("t")).withColumn("o", F.regexp_extract("graph_name", "^ncx_(.*?)__", 1))  # at most as many as types
    b = per.select("o", F.col("graph_name").alias("g2"), F.col("t").alias("t2"))
    return per.join(b, "o").where("graph_name < g2").select("graph_name", "g2", F.size(F.array_intersect("t", "t2")).cast("bigint").alias("n_common"), F.size(F.array_union("t", "t2")).cast("bigint").alias("n_all"))


def q6_hybrid(s, d):
    """Nodes with all words of the query by text rank; where there are none, those that hold it as a part, by name (1.0) or content (0.5)."""
    n = V.nodes(s, d, "name", "content", "forgotten").where("not forgotten")
    asked = s.createDataFrame([("weekly database",), ("ngine",), ("no such thing",)], "query string")
    doc = T.tokens(F.concat_ws(" ", "name", "content"))
    full = n.select("id", doc.alias("doc")).crossJoin(F.broadcast(asked)).where(T.matches_all(F.col("doc"), T.tokens(F.col("query"))))
    full = cut(full.select("query", "id", F.round(T.text_rank(F.col("doc"), T.tokens(F.col("query"))), 6).alias("relevance")))
    rest = asked.join(full.select("query").distinct(), "query", "left_anti")
    part = F.when(T.contains_ci(F.col("name"), F.col("query")), 1.0).when(T.contains_ci(F.col("content"), F.col("query")), 0.5)
    return full.unionByName(n.crossJoin(F.broadcast(rest)).select("query", "id", part.alias("relevance")).where("relevance is not null"))


def r3_granted(s, d):
    """Newest batch: who targeted a graph may read it, who forced it may write."""
    r = table(s, d, "ingest_requests").where("batch_no = 8 and target_graph is not null and agent_id is not null")
    delta = r.select("agent_id", F.col("target_graph").alias("graph_name"), F.lit(True).alias("can_read"), F.coalesce("force_flag", F.lit(False)).alias("can_write"))
    return permissions.grant(access.permissions(s, d), delta).select("agent_id", "graph_name", "can_read", "can_write")


def r3_revoked(s, d):
    p = access.permissions(s, d)
    return permissions.revoke(p, p.where("not can_write")).select("agent_id", "graph_name")


def r3_admins(s, d):
    a = access.agents(s, d)
    return permissions.set_admin(a, a.select("agent_id", F.lit(False).alias("is_admin")).where("agent_id like '%a%'"), "agent_atlas").where("agent_id is not null")


def _proposed(s, d):
    c = table(s, d, "ontology_classes").where("label is not null").select(T.slug(F.col("label")).alias("slug"), F.col("parent_class_id").alias("p")).distinct()
    known = V.domains(s, d).select("slug").distinct()
    return c.join(known.withColumnRenamed("slug", "parent_slug"), F.col("p") == F.col("parent_slug"), "left").select("slug", "parent_slug")


def r5_provisioned(s, d):
    """Ontology labels as proposed domains; parents that are no domain make roots."""
    return routing.provision(_proposed(s, d), V.domains(s, d).select("id", "slug", "depth", "path"))


def x16_guarded(s, d):
    """Types that may be deleted: those that no node has; the others are refused with the number of their nodes."""
    use = V.nodes(s, d, "type_id").groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias("n"))
    t = V.node_types(s, d).join(F.broadcast(use), "id", "left")
    return t.select("id", F.coalesce("n", F.lit(0)).alias("n_nodes"), F.col("n").isNull().alias("deleted"))


_INSTANCES = {"Task": "Project", "Routine": "Habit", "Emotion": "Mood"}


def x20_remapped(s, d):
    """Merges whose target type is created where it is missing; then types that no node has and no graph starts with go: nodes per type before and after."""
    n, t = V.nodes(s, d, "type_id"), V.node_types(s, d).select("id", "name")
    n2, t2 = store.mapped_types(n, t, _INSTANCES)
    t2 = cut(t2)
    gone = store.unused_types(t2, n2.select("type_id"), store.SEED_NODE_TYPES).select("id")
    count = lambda x, c: x.groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias(c))
    names = t.unionByName(t2.join(gone, "id", "left_anti")).distinct()
    return names.join(F.broadcast(count(n, "before")), "id", "left").join(F.broadcast(count(n2, "after")), "id", "left").select("name", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def x20_edge_types(s, d):
    """Edge types whose name is an artifact or that no edge has and no graph starts with; their edges become RELATES_TO. A dry run: what would go."""
    use = V.edges(s, d).groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias("n"))
    t = V.edge_types(s, d).join(F.broadcast(use), "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_edges"))
    bad = F.col("name").rlike(T.ARTIFACT)
    return t.select("id", "n_edges", F.when(bad, "to RELATES_TO").when((F.col("n_edges") == 0) & ~F.col("name").isin(store.SEED_EDGE_TYPES), "removed").otherwise("kept").alias("outcome"))


def _asked_edges(s, d):
    """Strong edges asked for again by names and the other way round, as RELATES_TO."""
    e = V.edges(s, d).where("weight >= 1.2")
    n = V.nodes(s, d, "graph_name", "name").select("graph_name", "id", "name")
    a, b = n.select("graph_name", F.col("id").alias("source_id"), F.col("name").alias("target")), n.select("graph_name", F.col("id").alias("target_id"), F.col("name").alias("source"))
    asked = e.join(a, ["graph_name", "source_id"], "left").join(b, ["graph_name", "target_id"], "left").select("graph_name", "source", "target", F.lit(101).cast("bigint").alias("type_id"), F.lit(1.0).alias("weight"), F.col("id").alias("seq"))
    return store.resolve_ends(asked, n)


def x31_states(s, d):
    return _asked_edges(s, d).groupBy("graph_name", "state").agg(F.count("*").alias("n"))


def x31_upserted(s, d):
    """The edge table after the edges asked for by names: edges per graph."""
    old = V.edges(s, d).where("source_id is not null and target_id is not null").groupBy("graph_name", "source_id", "target_id", "type_id").agg(F.max("weight").alias("weight"))
    new = _asked_edges(s, d).where("state = 'found'").select("graph_name", "source_id", "target_id", "type_id", "weight", "seq")
    return store.upsert_edges(old, new).groupBy("graph_name").agg(F.count("*").alias("n"))


def x21_payload(s, d):
    """A payload of classes: its types are registered, its nodes matched and upserted, its edges resolved by name among payload and graph and upserted; rows before and after."""
    from .changes import _delta, _typed_nodes

    c = _delta(s, d)
    t = V.node_types(s, d).select("name")
    t2 = store.register(t, c.select(T.node_type_name(F.col("type_name")).alias("name")).where("name is not null"), ["name"])
    n = _typed_nodes(s, d)
    alias = n.where("name is not null").select("graph_name", F.replace("name", F.lit("-"), F.lit(" ")).alias("alias"), F.col("id").alias("node_id"))
    n2 = cut(store.upsert_nodes(n, cut(store.match_nodes(cut(store.fold_delta(c)), n, alias)), AS_OF))
    cls = table(s, d, "ontology_classes").select("class_id", "label", "parent_class_id").distinct()
    up = cls.select(F.col("class_id").alias("parent_class_id"), F.col("label").alias("target"))
    asked = cls.join(up, "parent_class_id").select(F.lit("ncx_shared__work_context").alias("graph_name"), T.canonical_name(F.col("label")).alias("source"), T.canonical_name(F.col("target")).alias("target"), F.lit(101).cast("bigint").alias("type_id"), F.lit(1.0).alias("weight"), F.col("class_id").alias("seq"))
    old = V.edges(s, d).where("source_id is not null and target_id is not null").groupBy("graph_name", "source_id", "target_id", "type_id").agg(F.max("weight").alias("weight"))
    new = store.upsert_edges(old, store.resolve_ends(asked, n2).where("state = 'found'").select("graph_name", "source_id", "target_id", "type_id", "weight", "seq"))
    count = lambda x, y, name: x.agg(F.count("*").alias("before")).crossJoin(y.agg(F.count("*").alias("after"))).select(F.lit(name).alias("part"), "before", "after")
    return count(t, t2, "types").unionByName(count(n, n2, "nodes")).unionByName(count(old, new, "edges"))


def x23_deleted(s, d):
    """Domains left when those of one creator go; seeds stay whoever made them."""
    dom = V.domains(s, d)
    gone = dom.where("not coalesce(seed, false) and created_by is not null").select("id")
    return dom.join(gone, "id", "left_anti").select("id", "slug")


def x24_dropped(s, d):
    """Dropping the personal graphs takes their nodes and edges along."""
    reg = access.registry(s, d)
    gone = reg.where("purpose = 'personal'").select("graph_name")
    left = [x.join(gone, "graph_name", "left_anti").agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, x in (("graphs", reg), ("nodes", V.nodes(s, d, "graph_name").where("graph_name is not null")), ("edges", V.edges(s, d).where("graph_name is not null")))]
    return left[0].unionByName(left[1]).unionByName(left[2])


def x26_entities(s, d):
    n = V.nodes(s, d, "name").where("name is not null").select(F.lower("name").alias("entity"), F.col("name").alias("label"), F.col("id").alias("message"))
    return facts.last_entities(n)


def x26_properties(s, d):
    return facts.first_properties(_mentions(s, d))


def x26_mentions(s, d):
    return facts.mentions_of(_mentions(s, d)).groupBy("fact").agg(F.count("*").alias("n"))


def x26_run_log(s, d):
    """One row of the run log: what a run inserted."""
    m = _mentions(s, d).where("value is not null")
    parts = [m.agg(F.countDistinct("entity").alias("n_entities"), F.countDistinct("property").alias("n_properties")), facts.facts_of(m).agg(F.count("*").alias("n_facts")), facts.mentions_of(m).agg(F.count("*").alias("n_mentions"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


def x28_derived(s, d):
    """Facts that mentions imply and the store, filled from the even messages, lacks."""
    m = _mentions(s, d)
    have = facts.facts_of(m.where("message % 2 = 0"))
    return facts.facts_of(m).join(have.select("fact"), "fact", "left_anti").select("entity", "property", "value", "n_mentions")


def k1_extracted(s, d):
    """Episodes that name a graph stream into the extraction queue; each job has three attempts, and those of failed requests use them all."""
    src = P.read_stream(s, d, "ingest_requests").where("target_graph is not null").select(F.col("request_id").alias("id"), F.col("target_graph").alias("graph_name"))
    queue = P.run_once(jobs.enqueue(src))
    failed = table(s, d, "ingest_results").where("status = 'failed'").select(F.col("request_id").alias("episode_id")).distinct().withColumn("bad", F.lit(True))
    return jobs.run_attempts(queue.distinct().join(failed, "episode_id", "left"), F.col("bad").isNull()).select("episode_id", "task_name", "status", "attempts")


def k2_route_jobs(s, d):
    """Episodes without a graph stream into the routing task; each domain they are routed to enqueues an extraction job."""
    src = P.read_stream(s, d, "ingest_requests").where("target_graph is null and text is not null").select(F.col("request_id").alias("id"), "agent_id", "text")
    got = P.run_once(src).distinct()
    dom = access.registry(s, d).where("is_shared").select(F.col("purpose").alias("slug"), "graph_name")
    routed = routing.route(got, dom, access.permissions(s, d)).select("id", "graph_name")
    return routed.select(F.col("id").alias("episode_id"), "graph_name", F.lit("extract_episode").alias("task_name")).distinct()


def k4_enqueued(s, d):
    return jobs.enqueue(V.episodes(s, d)).groupBy("task_name", "queue_name", "status").agg(F.count("*").alias("n"))


def z6_edge_usage(s, d):
    use = V.edges(s, d).groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("graph_name").alias("n_graphs"))
    return V.edge_types(s, d).join(F.broadcast(use), "id", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_graphs", F.lit(0)).alias("n_graphs"), F.col("n").isNull().alias("unused"))


def z10_owners(s, d):
    return V.nodes(s, d, "owner_role", "graph_name").groupBy(F.coalesce("owner_role", F.lit("nobody")).alias("owner")).agg(F.count("*").alias("n"), F.countDistinct("graph_name").alias("n_graphs"))


def z10_orphaned_types(s, d):
    t = V.node_types(s, d).select(F.col("id").alias("type_id"))
    return V.nodes(s, d, "type_id").where("type_id is not null").join(F.broadcast(t), "type_id", "left_anti").groupBy("type_id").agg(F.count("*").alias("n"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
_ADJ = """, f as (select * from e where source_id is not null and target_id is not null),
  adj as (select graph_name, source_id as a, target_id as b, id as edge_id, 0 as i from f union all select graph_name, target_id, source_id, id, 1 from f)"""
_FOUND = ", fd as (select 'node' as kind, id, graph_name, round(importance, 1) as score from n where not forgotten and name is not null and graph_name is not null and contains(lower(name), 'engine'))"
_RT = access.SQL["r5_routed"]
_ASK = """, ask as (select e.graph_name, b.name as source, a.name as target, e.id as seq from e left join n a on a.graph_name = e.graph_name and a.id = source_id left join n b on b.graph_name = e.graph_name and b.id = target_id where weight >= 1.2),
  k as (select graph_name, lower(name) as k, min(id) as i from n where name is not null and graph_name is not null group by 1, 2),
  rs as (select ask.graph_name, x.i as source_id, y.i as target_id, case when x.i is null then 'source missing' when y.i is null then 'target missing' else 'found' end as state from ask
    left join k x on x.graph_name = ask.graph_name and x.k = lower(source) left join k y on y.graph_name = ask.graph_name and y.k = lower(target))"""
_SIG = "sha256(entity || chr(31) || property || chr(31) || norm)"
SQL = {
    "t16_lock_key": sql("n", """, h as (select id, string_split(left(sha256(name), 16), '') as x from n where name is not null)
      select id, cast(list_reduce(list_transform(x, lambda c: cast(strpos('0123456789abcdef', c) - 1 as hugeint)), lambda a, b: a * 16 + b) % 9223372036854775807 as bigint) as lock_key from h"""),
    "s8_media": "select doc_id, case when doc_format = 'transcript' then case when coalesce(n_chars, 0) * 40000 > 104857600 then 'too large' else 'audio' end when doc_format = 'events' then case when coalesce(n_chars, 0) * 40000 > 104857600 then 'too large' else 'video' end else 'refused' end as kind from documents",
    "s10_blob_paths": "select doc_id, case when doc_id % 3 = 1 then '/media/a/' || doc_id || '.ogg' end as path from documents",
    "s18_listed": "select 'b' as name",
    "j17_labels": sql("n e nt et", "select coalesce(et.name, '?') as rel, coalesce(nt.name, 'Untyped') as kind, count(*) as n from e left join et on et.id = e.type_id left join n on n.graph_name = e.graph_name and n.id = e.source_id left join nt on nt.id = n.type_id group by 1, 2"),
    "n6_superseded": sql("e et", ", h as (select e.* from e join et on et.id = e.type_id where et.name in ('SUPERSEDES', 'CORRECTS')), x as (select target_id as id, true as t from h union all select source_id, false from h) select id, bool_or(t) as is_target, bool_or(not t) as is_source from x where id is not null group by 1"),
    "n8_request_links": sql("n ep", """, x as (select try_cast(properties['_source_episode'] as bigint) as episode_id, created_at, id from n), fn as (select episode_id, min_by(id, (created_at, id)) as node_id from x where episode_id is not null group by 1),
      pv as (select id, lag(id) over (partition by agent_id, session_id order by created_at, id) as prev_id from ep where session_id is not null)
      select distinct a.node_id as source_id, b.node_id as target_id, 0.9::double as weight from pv join fn a on a.episode_id = pv.id join fn b on b.episode_id = pv.prev_id where a.node_id <> b.node_id"""),
    "w9_first_discovery": sql("n e", _ADJ + """, sd as (select graph_name, id as seed from n where graph_name = 'ncx_shared__work_context'),
      l1 as (select sd.graph_name, seed, b as node, min((i, edge_id)) as x from sd join adj on adj.graph_name = sd.graph_name and a = seed where b <> seed group by 1, 2, 3),
      l2 as (select l1.graph_name, seed, b as node, min((i, edge_id)) as x from l1 join adj on adj.graph_name = l1.graph_name and a = node where b <> seed and not exists (select 1 from l1 y where y.seed = l1.seed and y.node = b) group by 1, 2, 3)
      select seed, node, 1::bigint as distance, x[2] as edge_id from l1 union all select seed, node, 2::bigint, x[2] from l2"""),
    "o8_tie_break": sql("n ep", _FOUND + " select kind, id, score from (select * from fd union all select 'episode', id, graph_name, 0.5::double from ep where contains(lower(content), 'spare wheel')) order by score desc, kind desc, id limit 60"),
    "u3_fan_out": sql("n", _FOUND + " select graph_name, id, score from (select *, row_number() over (partition by graph_name order by score desc, id) as r from fd) where r <= 3"),
    "u5_type_sets": sql("n", ", p as (select graph_name, list(distinct type_id) as t, regexp_extract(graph_name, '^ncx_(.*?)__', 1) as o from n where graph_name is not null and type_id is not null group by 1) select a.graph_name, b.graph_name as g2, len(list_intersect(a.t, b.t)) as n_common, len(list_distinct(list_concat(a.t, b.t))) as n_all from p a join p b on a.o = b.o and a.graph_name < b.graph_name"),
    "r3_granted": f"""with {access._PERM}, dl as (select agent_id, target_graph as graph_name, true as can_read, bool_or(coalesce(force_flag, false)) as can_write from ingest_requests where batch_no = 8 and target_graph is not null and agent_id is not null group by 1, 2)
      select * from dl union all select * from pm where not exists (select 1 from dl where dl.agent_id = pm.agent_id and dl.graph_name = pm.graph_name)""",
    "r3_revoked": f"with {access._PERM} select agent_id, graph_name from pm where can_write",
    "r3_admins": f"with {access._AG} select agent_id, agent_id = 'agent_atlas' as is_admin from ag",
    "r5_provisioned": sql("dom", """, c as (select distinct trim(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '_') as slug, parent_class_id as p from ontology_classes where label is not null),
      o as (select c.slug, min(d.slug) as ps from c left join dom d on d.slug = c.p where c.slug <> '' and c.slug not in (select slug from dom where slug is not null) group by 1),
      u as (select slug, min((id, depth, path)) as x from dom group by 1)
      select o.slug, x[1] as parent_id, coalesce(x[2] + 1, 0)::bigint as depth, case when x[3] is null then o.slug else x[3] || '.' || o.slug end as path, 'ncx_shared__' || o.slug as schema_name, 0.6::double as confidence from o left join u on u.slug = ps"""),
    "x16_guarded": sql("n nt", "select nt.id, count(n.id) as n_nodes, count(n.id) = 0 as deleted from nt left join n on n.type_id = nt.id group by 1"),
    "x20_edge_types": sql("e et", f", u as (select type_id, count(*) as n from e group by 1) select et.id, coalesce(n, 0) as n_edges, case when regexp_matches(name, '{T.ARTIFACT}') then 'to RELATES_TO' when n is null and name not in ({', '.join(repr(x) for x in store.SEED_EDGE_TYPES)}) then 'removed' else 'kept' end as outcome from et left join u on u.type_id = et.id"),
    "x20_remapped": sql("n nt", f""", mp as (select * from (values {', '.join(str(x) for x in _INSTANCES.items())}) v(src, dst) where src in (select name from nt)),
      ms as (select dst, row_number() over (order by dst) as r from (select distinct dst from mp where dst not in (select name from nt))), t1 as (select id, name from nt union all select (select max(id) from nt) + r, dst from ms),
      mv as (select a.id as s, b.id as d from mp join t1 a on a.name = src join t1 b on b.name = dst), n2 as (select coalesce(d, type_id) as t from n left join mv on s = type_id),
      t2 as (select * from t1 where id not in (select s from mv) and (name in ({', '.join(repr(x) for x in store.SEED_NODE_TYPES)}) or id in (select t from n2 where t is not null)))
      select name, (select count(*) from n where type_id = al.id) as before, (select count(*) from n2 where t = al.id) as after from (select id, name from nt union select id, name from t2) al"""),
    "x31_states": sql("n e", _ASK + " select graph_name, state, count(*) as n from rs group by 1, 2"),
    "x31_upserted": sql("n e", _ASK + """, o as (select distinct graph_name, source_id, target_id, type_id from e where source_id is not null and target_id is not null), dl as (select distinct graph_name, source_id, target_id from rs where state = 'found'),
      one as (select graph_name, source_id, target_id from o group by 1, 2, 3 having count(*) = 1),
      add as (select * from dl where not exists (select 1 from one where one.graph_name = dl.graph_name and one.source_id = dl.source_id and one.target_id = dl.target_id)
        and not exists (select 1 from o where o.graph_name = dl.graph_name and o.source_id = dl.source_id and o.target_id = dl.target_id and o.type_id = 101))
      select graph_name, count(*) as n from (select graph_name from o union all select graph_name from add) group by 1"""),
    "x23_deleted": sql("dom", "select id, slug from dom where coalesce(seed, false) or created_by is null"),
    "x24_dropped": sql("n e", f""", {access._REG}, g as (select graph_name from rg where purpose = 'personal') select 'graphs' as part, count(*) as n from rg where graph_name not in (select graph_name from g)
      union all select 'nodes', count(*) from n where graph_name is not null and graph_name not in (select graph_name from g) union all select 'edges', count(*) from e where graph_name is not null and graph_name not in (select graph_name from g)"""),
    "x26_entities": sql("n", ", x as (select lower(name) as entity, name as label, id as message from n where name is not null) select entity, min_by(label, (-message, label)) as label, max(message) as message from x group by 1"),
    "x26_properties": sql("n", _MEN + "select property, min(message) as first_message from pr2 group by 1".replace("pr2", "(select message, kv.key as property from pr)")),
    "x26_mentions": sql("n", _MEN + f"select {_SIG} as fact, count(distinct message) as n from mn group by 1"),
    "x26_run_log": sql("n", _MEN + f"select count(distinct entity) as n_entities, count(distinct property) as n_properties, (select count(*) from ft) as n_facts, (select count(*) from (select distinct entity, property, norm, message from mn)) as n_mentions from mn"),
    "x28_derived": sql("n", _MEN + "select entity, property, value, n_mentions from ft where not exists (select 1 from mn where mn.entity = ft.entity and mn.property = ft.property and mn.norm = ft.norm and mn.message % 2 = 0)"),
    "k1_extracted": "with q as (select distinct request_id as episode_id from ingest_requests where target_graph is not null), b as (select distinct request_id from ingest_results where status = 'failed') select episode_id, 'extract_episode' as task_name, case when request_id is null then 'succeeded' else 'failed' end as status, case when request_id is null then 1 else 3 end::bigint as attempts from q left join b on request_id = episode_id",
    "k2_route_jobs": "select distinct rt.id as episode_id, graph_name, 'extract_episode' as task_name from (" + _RT + ") rt where rt.id in (select request_id from ingest_requests where target_graph is null)",
    "k4_enqueued": sql("ep", "select case when graph_name is null then 'route_episode' else 'extract_episode' end as task_name, 'extraction' as queue_name, 'todo' as status, count(distinct id) as n from ep group by 1"),
    "z6_edge_usage": sql("e et", "select et.name, count(e.id) as n, count(distinct graph_name) as n_graphs, count(e.id) = 0 as unused from et left join e on e.type_id = et.id group by et.id, et.name"),
    "z10_owners": sql("n", "select coalesce(owner_role, 'nobody') as owner, count(*) as n, count(distinct graph_name) as n_graphs from n group by 1"),
    "z10_orphaned_types": sql("n nt", "select type_id, count(*) as n from n where type_id is not null and type_id not in (select id from nt) group by 1"),
}
