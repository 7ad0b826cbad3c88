"""Joins, aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import scoring as S
from ..functions import text as T
from ..operators import pairs
from ..runtime import table
from ..views import AS_OF, sql
from .filters import tri_sim
from .scalars import ACT


def _named(s, d):
    t = V.node_types(s, d).select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    return V.nodes(s, d, "graph_name", "name", "type_id", "forgotten").join(F.broadcast(t), "type_id", "left")


def triples(edges, nodes, edge_types):
    """(graph_name, edge_id, src, rel, tgt): names of both ends and the type of every edge whose parts all resolve."""
    n = nodes.select("graph_name", "id", "name")
    t = F.broadcast(edge_types.select(F.col("id").alias("type_id"), F.col("name").alias("rel")))
    a = n.select("graph_name", F.col("id").alias("source_id"), F.col("name").alias("src"))
    b = n.select("graph_name", F.col("id").alias("target_id"), F.col("name").alias("tgt"))
    return edges.select("graph_name", F.col("id").alias("edge_id"), "source_id", "target_id", "type_id").join(t, "type_id").join(a, ["graph_name", "source_id"]).join(b, ["graph_name", "target_id"]).select("graph_name", "edge_id", "src", "rel", "tgt")


def j1_alias(s, d):
    alias = V.nodes(s, d, "name").where("name is not null").select(F.lower(F.trim("name")).alias("alias"), F.col("id").alias("node_id"))
    n = V.nodes(s, d, "name").where("lower(name) like 'hidden%'").select("id", F.lower("name").alias("alias"))
    return n.join(alias, "alias").select("id", "node_id", "alias")


def j2_type_default(s, d):
    return _named(s, d).select("id", "name", F.coalesce("type_name", F.lit("Untyped")).alias("type_name"))


def j3_triples(s, d):
    t = triples(V.edges(s, d), V.nodes(s, d, "graph_name", "name"), V.edge_types(s, d))
    return t.select("edge_id", "graph_name", F.concat_ws("→", "src", "rel", "tgt").alias("signature"))


def j4_connected_types(s, d):
    e, n = V.edges(s, d), V.nodes(s, d, "graph_name", "type_id")
    ends = e.select("graph_name", F.col("type_id").alias("edge_type_id"), F.col("source_id").alias("id")).unionByName(e.select("graph_name", F.col("type_id").alias("edge_type_id"), F.col("target_id").alias("id")))
    return ends.join(n, ["graph_name", "id"]).where("type_id is not null and edge_type_id is not null").select(F.col("type_id").alias("node_type_id"), "edge_type_id").distinct()


def j5_usage(s, d):
    n = V.nodes(s, d, "type_id").groupBy("type_id").agg(F.count("*").alias("n"))
    t = V.node_types(s, d)
    return t.join(F.broadcast(n), t["id"] == n["type_id"], "left").select("name", F.coalesce("n", F.lit(0)).alias("n_nodes"))


def j6_live_usage(s, d):
    n = V.nodes(s, d, "type_id", "forgotten").where("not forgotten").groupBy("type_id").agg(F.count("*").alias("n"))
    t = V.node_types(s, d)
    return t.join(F.broadcast(n), t["id"] == n["type_id"], "left").select("name", F.coalesce("n", F.lit(0)).alias("n_live"))


def j7_unused(s, d):
    t = V.edge_types(s, d).select(F.col("id").alias("type_id"), "name")
    e = V.edges(s, d).where("graph_name is not null").select("graph_name", "type_id").distinct()
    every = e.select("graph_name").distinct().crossJoin(F.broadcast(t))  # the type list is fixed
    return every.join(e, ["graph_name", "type_id"], "left_anti").select("graph_name", "type_id", "name")


def j8_similar_names(s, d):
    """Similar names within a graph, over all graphs: pairs between the first nodes of two names, and of a name's first node with its others."""
    n = V.nodes(s, d, "graph_name", "name", "forgotten").where("not forgotten")
    return pairs.name_links(n.select("id", "name", "graph_name"), 0.6, "graph_name").select("id_a", "id_b", F.round("sim", 6).alias("sim"))


def j9_prefix_pairs(s, d):
    t = V.edge_types(s, d).select("id", "name", F.substring("name", 1, 4).alias("p"))
    u = t.select(F.col("id").alias("id2"), F.col("name").alias("name2"), F.col("p").alias("p2"))
    return t.join(u, (F.col("p") == F.col("p2")) & (F.col("id") < F.col("id2"))).select("name", "name2")


def j10_cross_graph(s, d):
    n = V.nodes(s, d, "graph_name", "name", "forgotten").where("not forgotten and name is not null and graph_name is not null").groupBy(F.lower("name").alias("key"), "graph_name").agg(F.count("*").alias("n"))
    m = n.select("key", F.col("graph_name").alias("graph_b"), F.col("n").alias("n_b"))
    return n.join(m, "key").where("graph_name < graph_b").select("key", F.col("graph_name").alias("graph_a"), "graph_b", F.col("n").alias("n_a"), "n_b")


def j11_provenance(s, d):
    n = V.nodes(s, d, "properties").select("id", F.element_at("properties", "_source_episode").try_cast("bigint").alias("episode_id"))
    e = table(s, d, "graph_edges").select(F.element_at("properties", "_source_episode").try_cast("bigint").alias("episode_id")).where("episode_id is not null").groupBy("episode_id").agg(F.count("*").alias("n_edges"))
    return n.where("episode_id is not null").join(e, "episode_id").select("id", "episode_id", "n_edges")


def j12_parents(s, d):
    p = V.domains(s, d)
    up = p.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    return p.join(up, "parent_id", "left").select("id", "slug", "parent_slug")


def j13_failed_jobs(s, d):
    j = V.jobs(s, d)
    ev = V.job_events(j).where("type = 'failed'")
    return j.where("status = 'failed'").select("id", "agent_id").join(ev, F.col("id") == F.col("job_id")).select("id", "agent_id", F.col("at").alias("failed_at"))


def j14_timeline(s, d):
    from ..operators.jobs import timeline

    j = V.jobs(s, d)
    return timeline(j, V.job_events(j))


def j15_examples(s, d):
    from .ordered import examples_per_type

    ex = examples_per_type(V.nodes(s, d, "type_id", "name", "importance", "forgotten"), 5)
    return ex.groupBy("type_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), "|").alias("examples"))


def j16_alias_flag(s, d):
    n = V.nodes(s, d, "name").where("name is not null")
    alias = n.where("name <> lower(name)").select(F.lower("name").alias("a")).distinct()
    return n.join(alias, F.col("name") == F.col("a"), "left").select("id", F.col("a").isNotNull().alias("is_alias"))


def j18_merge_hits(s, d):
    q = T.tokens(F.lit("weekly database"))
    n = V.nodes(s, d, "name", "content", "importance")
    text = n.select("id", T.text_rank(T.tokens(F.col("content")), q).alias("text_rank")).where("text_rank > 0")
    vec = n.select("id", T.trigram_similarity(F.coalesce("name", F.lit("")), F.lit("weekly database")).alias("name_sim")).where("name_sim >= 0.3")
    return text.join(vec, "id", "full").select("id", F.round("text_rank", 6).alias("text_rank"), F.round("name_sim", 6).alias("name_sim"))


def j19_previous(s, d):
    w = Window.partitionBy("agent_id", "session_id").orderBy("created_at", "id")
    return V.episodes(s, d).where("session_id is not null").select("id", F.lag("id").over(w).alias("prev_id"))


def g1_counts(s, d):
    return V.nodes(s, d, "graph_name", "type_id").groupBy("graph_name", "type_id").agg(F.count("*").alias("n"))


def stats_by_graph(s, d):
    n = V.nodes(s, d, "graph_name", "forgotten", "access_count")
    a = n.groupBy("graph_name").agg(
        F.count("*").alias("n_nodes"), F.count_if("forgotten").alias("n_forgotten"), F.avg(F.when(~F.col("forgotten"), F.col("access_count"))).alias("avg_access"), F.count_if(~F.col("forgotten")).alias("n_live")
    )
    b = V.edges(s, d).groupBy("graph_name").agg(F.count("*").alias("n_edges"))
    return a.join(b, "graph_name", "full").na.fill(0, ["n_nodes", "n_forgotten", "n_live", "n_edges"])


def g2_stats(s, d):
    return stats_by_graph(s, d).select("graph_name", "n_nodes", "n_edges", "n_forgotten", F.round("avg_access", 6).alias("avg_access"))


def g3_rollup(s, d):
    x = stats_by_graph(s, d)
    return x.agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"), F.round(F.try_divide(F.sum(F.col("avg_access") * F.col("n_live")), F.sum("n_live")), 4).alias("avg_access"))


def g4_types(s, d):
    x = _named(s, d).where("type_name is not null").groupBy("type_name").agg(F.count("*").alias("n"), F.min("graph_name").alias("first_graph"))
    return x.select(F.row_number().over(Window.orderBy("type_name")).cast("bigint").alias("nr"), "type_name", "n", "first_graph")


def g5_job_summary(s, d):
    j = V.jobs(s, d)
    return j.agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("todo", "doing", "succeeded", "failed", "cancelled")], F.count("*").alias("total"))


def g6_routed(s, d):
    j = V.jobs(s, d)
    schema = F.get_json_object("args", "$.target_schema")
    return j.where(schema.isNotNull()).groupBy(schema.alias("graph_name")).agg(F.countDistinct(F.get_json_object("args", "$.episode_ids[0]")).alias("n_episodes"), F.countDistinct(F.get_json_object("args", "$.agent_id")).alias("n_agents"))


def g7_distinct(s, d):
    return V.edges(s, d).select("graph_name", "type_id").distinct()


def g8_next_sequence(s, d):
    return V.episodes(s, d).where("session_id is not null").groupBy("agent_id", "session_id").agg((F.count("*") + 1).alias("next_sequence"))


def g9_percentiles(s, d):
    e = V.edges(s, d).where("weight is not null")
    p = F.percentile("weight", [0.5, 0.95])
    return e.groupBy("graph_name").agg(F.min("weight").alias("least"), F.max("weight").alias("most"), F.round(F.avg("weight") + 1e-9, 4).alias("mean"), p.alias("p")).select("graph_name", "least", "most", "mean", F.round(F.col("p")[0], 6).alias("median"), F.round(F.col("p")[1], 6).alias("p95"))


def g10_duplicate_names(s, d):
    n = V.nodes(s, d, "graph_name", "name", "forgotten").where("not forgotten and name is not null")
    return n.groupBy("graph_name", F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids")).where("n > 1")


def g11_type_drift(s, d):
    n = V.nodes(s, d, "name", "type_id").where("name is not null")
    return n.groupBy(F.lower("name").alias("key")).agg(F.countDistinct("type_id").alias("n_types")).where("n_types > 1")


def g12_reuse(s, d):
    n = V.nodes(s, d, "graph_name", "type_id").where("graph_name is not null")
    return n.groupBy("graph_name").agg(F.round(F.try_divide(F.count("*"), F.nullif(F.countDistinct("type_id"), F.lit(0))), 2).alias("reuse"), F.round(100 * F.try_divide(F.count_if(F.col("type_id").isNull()), F.count("*")), 1).alias("untyped_pct"))


def g13_concentration(s, d):
    n = V.nodes(s, d, "graph_name", "type_id", "forgotten").where("not forgotten").groupBy("graph_name", "type_id").agg(F.count("*").alias("n"))
    return n.groupBy("graph_name").agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))


def g14_sibling_overlap(s, d):
    from ..operators.steward import top_types

    top = top_types(V.nodes(s, d, "graph_name", "type_id", "forgotten"), 5)
    own = top.select(F.col("graph_name").alias("a"), F.col("types").alias("ta"))
    oth = top.select(F.col("graph_name").alias("b"), F.col("types").alias("tb"))
    grp = lambda c: F.regexp_extract(c, "^ncx_(shared|[a-z]+)", 1)
    return own.join(oth, (grp(F.col("a")) == grp(F.col("b"))) & (F.col("a") < F.col("b"))).select("a", "b", F.round(T.set_similarity(F.col("ta"), F.col("tb")), 6).alias("overlap")).where("overlap > 0.5")


def g16_underused(s, d):
    e = V.episodes(s, d).where("graph_name is not null").groupBy("graph_name").agg(F.count("*").alias("routed"))
    known = V.nodes(s, d, "graph_name").select("graph_name").distinct().where("graph_name is not null")
    x = known.join(e, "graph_name", "left").na.fill(0, ["routed"])
    top = x.agg(F.max("routed").alias("top"))
    return x.crossJoin(F.broadcast(top)).where("top > 0 and routed <= 1").select("graph_name", "routed")


def g17_best_per_name(s, d):
    n = V.nodes(s, d, "name", "type_id", "importance").where("name is not null")
    return n.groupBy(F.lower("name").alias("key"), "type_id").agg(F.max_by("id", F.struct("importance", (-F.col("id")).alias("m"))).alias("id"), F.max("importance").alias("importance"))


def g18_normalized(s, d):
    n = V.nodes(s, d, "access_count", "graph_name").where("graph_name is not null")
    return n.select("id", F.round(F.try_divide(F.col("access_count"), F.max("access_count").over(Window.partitionBy("graph_name"))), 6).alias("share"))


def g19_owners(s, d):
    return V.nodes(s, d, "owner_role", "forgotten").groupBy("owner_role").agg(F.count("*").alias("n"), F.count_if("forgotten").alias("n_forgotten"))


def g20_mentions(s, d):
    n = V.nodes(s, d, "properties").select(F.element_at("properties", "_source_episode").alias("ep")).where("ep is not null")
    return n.groupBy("ep").agg(F.count("*").alias("mention_count"))


def g21_actions(s, d):
    n = V.nodes(s, d, "created_at", "forgotten")
    a = F.when(F.col("forgotten"), "archived").when(F.col("updated_at") == F.col("created_at"), "created").otherwise("updated")
    return n.agg(*[F.count_if(a == x).alias(x) for x in ("created", "updated", "archived")])


def g22_mean_activation(s, d):
    n = V.nodes(s, d, "graph_name", "access_count", "last_accessed_at", "forgotten").where("not forgotten")
    return n.groupBy("graph_name").agg(F.round(F.avg(S.activation(F.col("access_count"), F.col("last_accessed_at"), AS_OF)), 6).alias("activation"))


def u1_directions(s, d):
    from ..operators.graph import both_ways

    return both_ways(V.edges(s, d)).groupBy("graph_name", "node", "direction").agg(F.count("*").alias("n"))


def u2_metrics(s, d):
    parts = [("node_types", V.node_types(s, d)), ("edge_types", V.edge_types(s, d)), ("domains", V.domains(s, d)), ("nodes", V.nodes(s, d, "name"))]
    out = None
    for name, df in parts:
        x = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = x if out is None else out.unionByName(x)
    return out


def u4_missing(s, d):
    asked = V.episodes(s, d).where("content is not null").select(F.sha2("content", 256).alias("hash"))
    known = table(s, d, "ingest_results").where("content_hash is not null").select(F.lower(F.regexp_extract("content_hash", "([0-9A-Fa-f]{64})", 1)).alias("hash"))
    return asked.subtract(known)


def u6_allowed(s, d):
    from .access import permissions

    return permissions(s, d).where("can_read").select("graph_name").distinct().intersect(V.nodes(s, d, "graph_name").select("graph_name"))


def u7_ranked_union(s, d):
    n = V.nodes(s, d, "name", "importance").select(F.lit("node").alias("kind"), "id", F.col("importance").alias("score"), "name")
    e = V.episodes(s, d).where("content is not null").select(F.lit("episode").alias("kind"), "id", F.round(1 / F.length("content"), 6).alias("score"))
    return n.unionByName(e, allowMissingColumns=True).orderBy(F.desc("score"), F.desc("kind"), "id").limit(100)


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "jgu" and k[1:2].isdigit()}
_SIG = "n.graph_name = e.graph_name and"
SQL = {
    "j1_alias": sql("n", "select a.id, b.id as node_id, lower(trim(b.name)) as alias from n a join n b on lower(a.name) = lower(trim(b.name)) where lower(a.name) like 'hidden%'"),
    "j2_type_default": sql("n nt", "select n.id, n.name, coalesce(nt.name, 'Untyped') as type_name from n left join nt on nt.id = n.type_id"),
    "j3_triples": sql("n e et", """select e.id as edge_id, e.graph_name, concat_ws('→', a.name, et.name, b.name) as signature from e join et on et.id = e.type_id
      join n a on a.graph_name = e.graph_name and a.id = e.source_id join n b on b.graph_name = e.graph_name and b.id = e.target_id"""),
    "j4_connected_types": sql("n e", f"select distinct n.type_id as node_type_id, e.type_id as edge_type_id from e join n on {_SIG} (n.id = e.source_id or n.id = e.target_id) where n.type_id is not null and e.type_id is not null"),
    "j5_usage": sql("n nt", "select nt.name, count(n.id) as n_nodes from nt left join n on n.type_id = nt.id group by nt.id, nt.name"),
    "j6_live_usage": sql("n nt", "select nt.name, count(n.id) as n_live from nt left join n on n.type_id = nt.id and not n.forgotten group by nt.id, nt.name"),
    "j7_unused": sql("e et", ", gs as (select distinct graph_name from e where graph_name is not null), x as (select distinct graph_name, type_id from e) select gs.graph_name, et.id as type_id, et.name from gs cross join et left join x on x.type_id = et.id and x.graph_name = gs.graph_name where x.type_id is null"),
    "j8_similar_names": sql("n", f""", x as (select id, lower(name) as k, graph_name from n where not forgotten and name is not null and graph_name is not null and regexp_matches(name, '[\\p{{L}}\\p{{N}}]')),
      r as (select graph_name, k, min(id) as id from x group by 1, 2), p as (select least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b, {tri_sim('a.k', 'b.k')} as s from r a join r b on a.graph_name = b.graph_name and a.k < b.k)
      select id_a, id_b, round(s, 6) as sim from p where s >= 0.6 union all select r.id, x.id, 1.0 from x join r using (graph_name, k) where x.id <> r.id"""),
    "j9_prefix_pairs": sql("et", "select a.name, b.name as name2 from et a join et b on left(a.name, 4) = left(b.name, 4) and a.id < b.id"),
    "j10_cross_graph": sql("n", """, x as (select lower(name) as key, graph_name, count(*) as n from n where not forgotten and name is not null and graph_name is not null group by 1, 2)
      select a.key, a.graph_name as graph_a, b.graph_name as graph_b, a.n as n_a, b.n as n_b from x a join x b on a.key = b.key and a.graph_name < b.graph_name"""),
    "j11_provenance": sql("n", """, x as (select try_cast(properties['_source_episode'] as bigint) as episode_id, count(*) as n_edges from graph_edges group by 1)
      select n.id, x.episode_id, n_edges from n join x on x.episode_id = try_cast(n.properties['_source_episode'] as bigint)"""),
    "j12_parents": sql("dom", "select a.id, a.slug, b.slug as parent_slug from dom a left join dom b on b.id = a.parent_id"),
    "j13_failed_jobs": sql("ep jb jv", "select jb.id, agent_id, jv.at as failed_at from jb join jv on jv.job_id = jb.id and jv.type = 'failed' where status = 'failed'"),
    "j14_timeline": sql("ep jb jv", """select id, task_name, status, (select min(jv.at) from jv where job_id = jb.id and type = 'deferred') as deferred_at, (select max(jv.at) from jv where job_id = jb.id and type = 'started') as started_at,
      (select max(jv.at) from jv where job_id = jb.id and type in ('succeeded', 'failed')) as finished_at from jb"""),
    "j15_examples": sql("n", ", r as (select type_id, name, row_number() over (partition by type_id order by importance desc, id) as r from n where not forgotten and name is not null and type_id is not null) select type_id, string_agg(name, '|' order by r) as examples from r where r <= 5 group by 1"),
    "j16_alias_flag": sql("n", "select id, name in (select lower(name) from n where name <> lower(name)) as is_alias from n where name is not null"),
    "j18_merge_hits": sql("n", f""", t as (select id, len(list_filter(string_split_regex(lower(coalesce(content, '')), '[^a-z0-9]+'), lambda w: w in ('weekly', 'database')))::double as tf from n),
      v as (select id, {tri_sim("coalesce(name, '')", "'weekly database'")} as s from n)
      select coalesce(a.id, b.id) as id, round(tf / (tf + 1), 6) as text_rank, round(s, 6) as name_sim from (select * from t where tf > 0) a full join (select * from v where s >= 0.3) b on a.id = b.id"""),
    "j19_previous": sql("ep", "select id, lag(id) over (partition by agent_id, session_id order by created_at, id) as prev_id from ep where session_id is not null"),
    "g1_counts": sql("n", "select graph_name, type_id, count(*) as n from n group by 1, 2"),
    "g2_stats": sql("n e", """, a as (select graph_name, count(*) as n_nodes, count(*) filter (where forgotten) as n_forgotten, avg(access_count) filter (where not forgotten) as av from n group by 1),
      b as (select graph_name, count(*) as n_edges from e group by 1)
      select coalesce(a.graph_name, b.graph_name) as graph_name, coalesce(n_nodes, 0) as n_nodes, coalesce(n_edges, 0) as n_edges, coalesce(n_forgotten, 0) as n_forgotten, round(av, 6) as avg_access from a full join b on a.graph_name = b.graph_name"""),
    "g3_rollup": sql("n e", "select (select count(*) from n) as n_nodes, (select count(*) from e) as n_edges, round((select avg(access_count) from n where not forgotten), 4) as avg_access"),
    "g4_types": sql("n nt", "select row_number() over (order by nt.name) as nr, nt.name as type_name, count(*) as n, min(graph_name) as first_graph from n join nt on nt.id = n.type_id group by nt.name"),
    "g5_job_summary": sql("ep jb", "select count(*) filter (where status = 'todo') as todo, count(*) filter (where status = 'doing') as doing, count(*) filter (where status = 'succeeded') as succeeded, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'cancelled') as cancelled, count(*) as total from jb"),
    "g6_routed": sql("ep jb", "select args->>'$.target_schema' as graph_name, count(distinct args->>'$.episode_ids[0]') as n_episodes, count(distinct args->>'$.agent_id') as n_agents from jb where args->>'$.target_schema' is not null group by 1"),
    "g7_distinct": sql("e", "select distinct graph_name, type_id from e"),
    "g8_next_sequence": sql("ep", "select agent_id, session_id, count(*) + 1 as next_sequence from ep where session_id is not null group by 1, 2"),
    "g9_percentiles": sql("e", "select graph_name, min(weight) as least, max(weight) as most, round(avg(weight) + 1e-9, 4) as mean, round(percentile_cont(0.5) within group (order by weight), 6) as median, round(percentile_cont(0.95) within group (order by weight), 6) as p95 from e where weight is not null group by 1"),
    "g10_duplicate_names": sql("n", "select graph_name, lower(name) as key, count(*) as n, string_agg(cast(id as varchar), ',' order by id) as ids from n where not forgotten and name is not null group by 1, 2 having count(*) > 1"),
    "g11_type_drift": sql("n", "select lower(name) as key, count(distinct type_id) as n_types from n where name is not null group by 1 having count(distinct type_id) > 1"),
    "g12_reuse": sql("n", "select graph_name, round(count(*) / nullif(count(distinct type_id), 0)::double, 2) as reuse, round(100 * count(*) filter (where type_id is null) / count(*)::double, 1) as untyped_pct from n where graph_name is not null group by 1"),
    "g13_concentration": sql("n", ", x as (select graph_name, type_id, count(*) as n from n where not forgotten group by 1, 2) select graph_name, round(max(n) / sum(n)::double, 6) as top_share from x group by 1"),
    "g14_sibling_overlap": sql("n", """, c as (select graph_name, type_id, count(*) as n from n where not forgotten and type_id is not null and graph_name is not null group by 1, 2),
      r as (select *, row_number() over (partition by graph_name order by n desc, type_id) as r from c), t as (select graph_name as g, list(type_id) as ts, regexp_extract(graph_name, '^ncx_(shared|[a-z]+)', 1) as grp from r where r <= 5 group by 1, 3),
      x as (select a.g as a, b.g as b, len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts)))::double as o from t a join t b on a.grp = b.grp and a.g < b.g)
      select a, b, round(o, 6) as overlap from x where o > 0.5"""),
    "g16_underused": sql("n ep", ", x as (select g.graph_name, count(ep.id) as routed from (select distinct graph_name from n where graph_name is not null) g left join ep on ep.graph_name = g.graph_name group by 1) select * from x where routed <= 1 and (select max(routed) from x) > 0"),
    "g17_best_per_name": sql("n", "select lower(name) as key, type_id, max_by(id, (importance, -id)) as id, max(importance) as importance from n where name is not null group by 1, 2"),
    "g18_normalized": sql("n", "select id, round(access_count / nullif(max(access_count) over (partition by graph_name), 0)::double, 6) as share from n where graph_name is not null"),
    "g19_owners": sql("n", "select owner_role, count(*) as n, count(*) filter (where forgotten) as n_forgotten from n group by 1"),
    "g20_mentions": sql("n", "select properties['_source_episode'] as ep, count(*) as mention_count from n where properties['_source_episode'] is not null group by 1"),
    "g21_actions": sql("n", "select count(*) filter (where not forgotten and updated_at = created_at) as created, count(*) filter (where not forgotten and updated_at is distinct from created_at) as updated, count(*) filter (where forgotten) as archived from n"),
    "g22_mean_activation": sql("n", f"select graph_name, round(avg({ACT}), 6) as activation from n where not forgotten group by 1"),
    "u1_directions": sql("e", ", x as (select * from e where source_id is not null and target_id is not null) select graph_name, source_id as node, 'out' as direction, count(*) as n from x group by 1, 2 union all select graph_name, target_id, 'in', count(*) from x group by 1, 2"),
    "u2_metrics": sql("n nt et dom", "select 'node_types' as metric, count(*) as n from nt union all select 'edge_types', count(*) from et union all select 'domains', count(*) from dom union all select 'nodes', count(*) from n"),
    "u4_missing": sql("ep", "select sha256(content) as hash from ep where content is not null except select lower(regexp_extract(content_hash, '([0-9A-Fa-f]{64})', 1)) from ingest_results where content_hash is not null"),
    "u6_allowed": sql("n", "select distinct target_graph as graph_name from ingest_requests where target_graph in (select graph_name from n)"),
    "u7_ranked_union": sql("n ep", """, x as (select 'node' as kind, id, importance as score, name from n union all select 'episode', id, round(1 / length(content)::double, 6), null from ep where content is not null)
      select * from x order by score desc, kind desc, id limit 100"""),
}
