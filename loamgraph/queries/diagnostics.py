"""Diagnostic queries: the reports an operator of the memory graph runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import scoring as S
from ..functions import text as T
from ..operators import pairs
from ..operators.jobs import stuck
from ..runtime import table
from ..views import AS_OF, sql
from .aggregates import triples
from .filters import tri_sim
from .scalars import ACT, REC


def _types(s, d):
    return V.node_types(s, d).select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))


def z1_newest(s, d):
    n = V.nodes(s, d, "name", "type_id", "created_at").join(F.broadcast(_types(s, d)), "type_id", "left")
    return n.orderBy(F.desc("created_at"), F.desc("id")).limit(30).select("id", "name", "type_name", "created_at")


def z2_duplicate_edges(s, d):
    e = V.edges(s, d).where("source_id is not null and target_id is not null")
    return e.groupBy("graph_name", "source_id", "target_id", "type_id").agg(F.count("*").alias("n"), F.round(F.max("weight") - F.min("weight"), 4).alias("spread")).where("n > 1")


def z3_top_edges(s, d):
    t = triples(V.edges(s, d), V.nodes(s, d, "graph_name", "name"), V.edge_types(s, d))
    e = V.edges(s, d).where("weight is not null").select("graph_name", F.col("id").alias("edge_id"), "weight")
    return t.join(e, ["graph_name", "edge_id"]).orderBy(F.desc("weight"), "edge_id").limit(30).select("edge_id", "src", "rel", "tgt", "weight")


def z4_type_diversity(s, d):
    n = V.nodes(s, d, "name", "type_id", "forgotten").where("not forgotten and name is not null").groupBy(F.lower("name").alias("key")).agg(F.countDistinct("type_id").alias("k"))
    return n.agg(F.count("*").alias("n_names"), F.count_if(F.col("k") > 1).alias("n_drifting"), F.max("k").alias("most"))


def z5_similar_types(s, d):
    return pairs.trigram_pairs(V.edge_types(s, d).select("id", "name"), 0.3).select("id_a", "id_b", F.round("sim", 6).alias("sim"))


def z7_health(s, d):
    n, e = V.nodes(s, d, "forgotten", "type_id", "name", "embedding"), V.edges(s, d)
    a = n.agg(F.count("*").alias("n_nodes"), F.count_if("forgotten").alias("n_forgotten"), F.count_if(F.col("type_id").isNull()).alias("n_untyped"), F.count_if(F.size("embedding") == 64).alias("n_embedded"))
    b = e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("weight") < 0).alias("n_negative"), F.count_if(F.col("weight").isNull()).alias("n_unweighted"))
    return a.crossJoin(F.broadcast(b))


def z8_dampening(s, d):
    n = V.nodes(s, d, "access_count", "last_accessed_at").where("access_count > 0")
    h = S.hours_since(F.col("last_accessed_at"), AS_OF)
    plain = 1 / (1 + F.exp(-(F.ln(F.col("access_count") + 1.0) - S.ACT_DECAY * F.ln(h + 1))))
    return n.where("last_accessed_at is not null").select("id", F.round(plain, 6).alias("original"), F.round(S.activation(F.col("access_count"), F.col("last_accessed_at"), AS_OF), 6).alias("dampened"))


def z9_superseded(s, d):
    t = triples(V.edges(s, d), V.nodes(s, d, "graph_name", "name"), V.edge_types(s, d))
    return t.where("rel in ('SUPERSEDES', 'CORRECTS')").select("edge_id", "src", "rel", "tgt")


def z9_recency_gain(s, d):
    n = V.nodes(s, d, "created_at")
    gain = S.recency(F.greatest("created_at", "updated_at"), AS_OF) - S.recency(F.col("created_at"), AS_OF)
    return n.select("id", F.round(gain, 6).alias("gain")).where("gain > 0.01")


def z10_failures(s, d):
    j = V.jobs(s, d)
    return j.groupBy("agent_id").agg(F.count("*").alias("n"), F.round(100 * F.try_divide(F.count_if(F.col("status") == "failed"), F.count("*")), 2).alias("failed_pct"))


def z11_stuck(s, d):
    j = V.jobs(s, d)
    return stuck(j, V.job_events(j), AS_OF, 60).select("id", "task_name", F.round("waiting_minutes", 3).alias("waiting_minutes"))


def z12_duplicate_hashes(s, d):
    e = V.episodes(s, d).where("content is not null")
    return e.groupBy(F.sha2("content", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.countDistinct("agent_id").alias("n_agents")).where("n > 1")


def z13_type_audit(s, d):
    c = table(s, d, "ontology_classes").select("class_id", "label").distinct().where("label is not null")
    return c.select("class_id", F.length("label").cast("bigint").alias("n_chars"), F.col("label").rlike(T.ARTIFACT).alias("artifact"), (F.size(F.split("label", " ")) > 3).alias("long_name"))


def z14_seed_use(s, d):
    from ..operators.store import SEED_NODE_TYPES

    seed = V.node_types(s, d).where(F.col("name").isin(SEED_NODE_TYPES))
    n = V.nodes(s, d, "type_id", "graph_name").where("graph_name is not null")
    per = n.groupBy("graph_name", F.col("type_id").alias("id")).agg(F.count("*").alias("n"))
    every = n.select("graph_name").distinct().crossJoin(F.broadcast(seed.select("id", "name")))  # the seed types are fixed
    return every.join(per, ["graph_name", "id"], "left").select("graph_name", "name", F.coalesce("n", F.lit(0)).alias("n"))


def z14_last_error(s, d):
    j = V.jobs(s, d).where("status = 'failed'")
    return j.groupBy(F.get_json_object("args", "$.agent_id").alias("agent_id")).agg(F.max_by("id", F.struct("scheduled_at", "id")).alias("job_id"))


def z15_utilisation(s, d):
    n = V.nodes(s, d, "graph_name", "type_id", "forgotten").where("not forgotten and graph_name is not null").groupBy("graph_name").agg(F.count("*").alias("n_nodes"), F.countDistinct("type_id").alias("n_types"))
    r = V.episodes(s, d).where("graph_name is not null").groupBy("graph_name").agg(F.count("*").alias("n_routed"))
    return n.join(r, "graph_name", "left").select("graph_name", "n_nodes", "n_types", F.coalesce("n_routed", F.lit(0)).alias("n_routed"))


def z16_follows_audit(s, d):
    t = V.edge_types(s, d).where("name = 'FOLLOWS'").select(F.col("id").alias("type_id"))
    e = table(s, d, "graph_edges").join(F.broadcast(t), "type_id", "left_semi").where("properties is not null")
    return e.groupBy(F.map_contains_key("properties", "_source_episode").alias("has_episode")).agg(F.countDistinct("id").alias("n"))


def z16_sessions(s, d):
    e = V.episodes(s, d)
    return e.groupBy("session_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")).where("session_id is null or n > 1")


def z17_case_variants(s, d):
    n = V.nodes(s, d, "name").where("name is not null")
    return n.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.countDistinct("name").alias("n_spellings"), F.count("*").alias("n")).where("n_spellings > 1")


def z18_like_report(s, d):
    n = V.nodes(s, d, "graph_name", "name", "type_id").where("lower(name) like '%engine%'").join(F.broadcast(_types(s, d)), "type_id", "left")
    return n.groupBy("type_name").agg(F.count("*").alias("n"), F.countDistinct("graph_name").alias("n_graphs"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "z" and k[1:2].isdigit()}
_TR = """, tr as (select e.id as edge_id, e.graph_name, a.name as src, et.name as rel, b.name as tgt, weight from e join et on et.id = e.type_id
      join n a on a.graph_name = e.graph_name and a.id = e.source_id join n b on b.graph_name = e.graph_name and b.id = e.target_id)"""
_H = f"greatest((epoch_us(timestamp '{AS_OF}') - epoch_us(last_accessed_at)) / 3.6e9::double, 0.0)"
SQL = {
    "z1_newest": sql("n nt", "select n.id, n.name, nt.name as type_name, n.created_at from n left join nt on nt.id = n.type_id order by n.created_at desc nulls last, n.id desc limit 30"),
    "z2_duplicate_edges": sql("e", "select graph_name, source_id, target_id, type_id, count(*) as n, round(max(weight) - min(weight), 4) as spread from e where source_id is not null and target_id is not null group by 1, 2, 3, 4 having count(*) > 1"),
    "z3_top_edges": sql("n e et", _TR + "select edge_id, src, rel, tgt, weight from tr where weight is not null order by weight desc, edge_id limit 30"),
    "z4_type_diversity": sql("n", ", x as (select lower(name) as key, count(distinct type_id) as k from n where not forgotten and name is not null group by 1) select count(*) as n_names, count(*) filter (where k > 1) as n_drifting, max(k) as most from x"),
    "z5_similar_types": sql("et", f", p as (select a.id as id_a, b.id as id_b, {tri_sim('a.name', 'b.name')} as s from et a join et b on a.id < b.id) select id_a, id_b, round(s, 6) as sim from p where s >= 0.3"),
    "z7_health": sql("n e", """, a as (select count(*) as n_nodes, count(*) filter (where forgotten) as n_forgotten, count(*) filter (where type_id is null) as n_untyped, count(*) filter (where len(embedding) = 64) as n_embedded from n),
      b as (select count(*) as n_edges, count(*) filter (where weight < 0) as n_negative, count(*) filter (where weight is null) as n_unweighted from e) select * from a, b"""),
    "z8_dampening": sql("n", f"select id, round(1 / (1 + exp(-(ln(access_count + 1.0::double) - 0.5 * ln({_H} + 1)))), 6) as original, round({ACT}, 6) as dampened from n where access_count > 0 and last_accessed_at is not null"),
    "z9_superseded": sql("n e et", _TR + "select edge_id, src, rel, tgt from tr where rel in ('SUPERSEDES', 'CORRECTS')"),
    "z9_recency_gain": sql("n", f", x as (select id, round({REC.format('greatest(created_at, updated_at)')} - {REC.format('created_at')}, 6) as gain from n) select * from x where gain > 0.01"),
    "z10_failures": sql("ep jb", "select agent_id, count(*) as n, round(100 * count(*) filter (where status = 'failed') / count(*)::double, 2) as failed_pct from jb group by 1"),
    "z11_stuck": sql("ep jb jv", f""", t as (select id, task_name, (select min(jv.at) from jv where job_id = jb.id and type = 'deferred') as de from jb where status in ('todo', 'doing')),
      w as (select id, task_name, (epoch_us(timestamp '{AS_OF}') - epoch_us(de)) / 6e7::double as m from t) select id, task_name, round(m, 3) as waiting_minutes from w where m > 60"""),
    "z12_duplicate_hashes": sql("ep", "select sha256(content) as hash, count(*) as n, min(id) as first_id, count(distinct agent_id) as n_agents from ep where content is not null group by 1 having count(*) > 1"),
    "z13_type_audit": "select distinct class_id, length(label) as n_chars, regexp_matches(label, '(?i)(functiondefault|calldefault|updatenode|createorupdate|functionname)') as artifact, len(string_split(label, ' ')) > 3 as long_name from ontology_classes where label is not null",
    "z14_last_error": sql("ep jb", "select args->>'$.agent_id' as agent_id, max_by(id, (scheduled_at, id)) as job_id from jb where status = 'failed' group by 1"),
    "z15_utilisation": sql("n ep", ", a as (select graph_name, count(*) as n_nodes, count(distinct type_id) as n_types from n where not forgotten and graph_name is not null group by 1) select a.*, coalesce(r, 0) as n_routed from a left join (select graph_name as g, count(*) as r from ep where graph_name is not null group by 1) on g = a.graph_name"),
    "z16_follows_audit": "select map_contains(properties, '_source_episode') as has_episode, count(distinct id) as n from graph_edges where type_id = (select id from graph_edge_types where name = 'FOLLOWS') and properties is not null group by 1",
    "z16_sessions": sql("ep", "select session_id, count(*) as n, min(created_at) as first_at, max(created_at) as last_at from ep group by 1 having session_id is null or count(*) > 1"),
    "z17_case_variants": sql("n", "select lower(trim(name)) as key, count(distinct name) as n_spellings, count(*) as n from n where name is not null group by 1 having count(distinct name) > 1"),
    "z18_like_report": sql("n nt", "select nt.name as type_name, count(*) as n, count(distinct graph_name) as n_graphs from n left join nt on nt.id = n.type_id where lower(n.name) like '%engine%' group by 1"),
}
from ..operators.store import SEED_NODE_TYPES as _SEED  # noqa: E402

SQL["z14_seed_use"] = sql("n nt", f", gs as (select distinct graph_name from n where graph_name is not null) select gs.graph_name, nt.name, count(n.id) as n from gs cross join nt left join n on n.type_id = nt.id and n.graph_name = gs.graph_name where nt.name in ({', '.join(repr(x) for x in _SEED)}) group by 1, 2")
