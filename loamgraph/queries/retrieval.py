"""Retrieval composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as T
from ..operators import graph as G
from ..operators import retrieval as R
from ..runtime import cut, table
from ..views import AS_OF, sql
from .aggregates import triples
from .integrity import _P1
from .filters import SIM, TRI, tri_sim
from .ordered import examples_per_type
from .scalars import _T3, ACT, REC

QUERY, LIMIT = "weekly database", 10


def _flags(s, d):
    return G.supersession_flags(V.edges(s, d), V.edge_types(s, d))


def _query_vector(s, d):
    """(q): the usable embedding of the smallest node id, one row."""
    n = V.nodes(s, d, "embedding").where("size(embedding) = 64")
    return n.agg(F.min_by("embedding", "id").alias("q"))


def _scored_nodes(s, d):
    n = V.nodes(s, d).drop("properties").crossJoin(F.broadcast(_query_vector(s, d)))
    return R.score_nodes(R.node_candidates(n, QUERY, F.col("q"), LIMIT), _flags(s, d), AS_OF)


def q1_recall(s, d):
    """Nodes and episodes scored, nodes raised by spreading activation from the five best, the ten best of all."""
    nodes = cut(_scored_nodes(s, d))  # at most 3 * LIMIT rows, used three times
    eps = R.score_episodes(R.episode_candidates(V.episodes(s, d), QUERY, LIMIT), AS_OF)
    seeds = nodes.orderBy(F.desc("score"), "id").limit(5)
    edges = V.edges(s, d).where("weight > 0")
    items = R.add_bonus(nodes.unionByName(eps), edges, seeds.select("graph_name", "id", "score"))
    return R.ranked(items, LIMIT).select("kind", "id", "score")


def q2_merged(s, d):
    items = _scored_nodes(s, d).unionByName(R.score_episodes(R.episode_candidates(V.episodes(s, d), QUERY, LIMIT), AS_OF))
    return R.ranked(items, LIMIT).select("kind", "id", "score")


def q3_nodes(s, d):
    return _scored_nodes(s, d).select("id", "graph_name", "score")


def q3_episodes(s, d):
    eps = R.score_episodes(R.episode_candidates(V.episodes(s, d), QUERY, LIMIT), AS_OF)
    return R.with_session_neighbours(eps, V.episodes(s, d).select("id", "agent_id", "session_id", "created_at"))


def q4_text_and_vector(s, d):
    n = V.nodes(s, d, "name", "content", "embedding", "forgotten").where("not forgotten").crossJoin(F.broadcast(_query_vector(s, d)))
    text = n.select("id", T.text_rank(T.tokens(F.col("content")), T.tokens(F.lit(QUERY))).alias("t")).where("t > 0").orderBy(F.desc("t"), "id").limit(20)
    vec = n.select("id", F.round(R.similarity_to(F.col("q")), 5).alias("v")).where("v is not null").orderBy(F.desc("v"), "id").limit(20)
    return text.join(vec, "id", "full").select("id", F.round("t", 6).alias("text_rank"), F.col("v").alias("vector_sim"))


def q5_recall(s, d):
    return R.simple_recall(V.nodes(s, d, "name", "content", "forgotten", "created_at", "access_count", "last_accessed_at", "importance"), "report", AS_OF)


def q6_search(s, d):
    n = V.nodes(s, d, "name", "content", "forgotten").where("not forgotten")
    r = F.when(T.contains_ci(F.col("name"), F.lit("garden")), 1.0).when(T.contains_ci(F.col("content"), F.lit("garden")), 0.5)
    return n.select("id", r.alias("relevance")).where("relevance is not null").orderBy(F.desc("relevance"), "id").limit(100)


def q7_vector_neighbours(s, d):
    n = V.nodes(s, d, "graph_name", "embedding", "forgotten").where("not forgotten").crossJoin(F.broadcast(_query_vector(s, d)))
    top = n.select("graph_name", "id", F.round(R.similarity_to(F.col("q")), 5).alias("sim")).where("sim is not null").orderBy(F.desc("sim"), "id").limit(5)
    adj = G.both_ways(V.edges(s, d)).select("graph_name", F.col("node").alias("id"), "nbr")
    near = top.join(adj, ["graph_name", "id"], "left").groupBy("id", "sim").agg(F.array_join(F.transform(F.sort_array(F.collect_set("nbr")), lambda x: x.cast("string")), ",").alias("neighbours"))
    return near.select("id", "sim", "neighbours")


def q9_cascade(s, d):
    n = V.nodes(s, d, "name", "forgotten").where("not forgotten").select("id", "name")
    alias = n.where("name is not null").select(F.replace(F.lower("name"), F.lit(" "), F.lit("-")).alias("alias"), F.col("id").alias("node_id"))
    q = s.createDataFrame([("HIDDEN ENGINE",), ("weekly-database",), ("Practical Servce",), ("qqq zzz",)], "query string")
    return R.cascade(q, n, alias)


def q10_similar_types(s, d):
    t = V.node_types(s, d).select("id", "name", F.round(T.trigram_similarity(F.col("name"), F.lit("Persons")), 6).alias("sim"), "description")
    hit = t.where((F.col("sim") > 0.2) | T.contains_ci(F.col("name"), F.lit("son")) | T.contains_ci(F.coalesce("description", F.lit("")), F.lit("persons")))
    use = V.nodes(s, d, "type_id", "forgotten").where("not forgotten").groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias("n"))
    return hit.join(F.broadcast(use), "id", "left").select("name", "sim", F.coalesce("n", F.lit(0)).alias("n_live")).orderBy(F.desc("sim"), "name").limit(10)


def _usage(s, d):
    use = V.nodes(s, d, "type_id", "forgotten").where("not forgotten").groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias("n"))
    return V.node_types(s, d).join(F.broadcast(use), "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def q11_summary(s, d):
    u = _usage(s, d)
    total = u.agg(F.sum("n").alias("total"), F.count("*").alias("n_types"))
    return u.crossJoin(F.broadcast(total)).select("name", "n", "total", "n_types")


def q12_edge_usage(s, d):
    e = V.edges(s, d).groupBy(F.col("type_id").alias("id")).agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean_weight"))
    return V.edge_types(s, d).join(F.broadcast(e), "id", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), "mean_weight")


def q13_type_detail(s, d):
    n = V.nodes(s, d, "graph_name", "type_id", "name", "importance", "forgotten")
    ends = G.both_ways(V.edges(s, d)).select("graph_name", F.col("node").alias("id"), F.col("type_id").alias("et"))
    conn = n.select("graph_name", "id", "type_id").join(ends, ["graph_name", "id"]).where("type_id is not null and et is not null").groupBy("type_id").agg(F.countDistinct("et").alias("n_edge_types"))
    ex = examples_per_type(n, 3).groupBy("type_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), "|").alias("samples"))
    return _usage(s, d).withColumnRenamed("id", "type_id").join(conn, "type_id", "left").join(ex, "type_id", "left").select("name", "n", F.coalesce("n_edge_types", F.lit(0)).alias("n_edge_types"), "samples")


def q15_browse(s, d):
    n = V.nodes(s, d, "graph_name", "type_id", "name", "content", "importance", "access_count", "forgotten")
    t = V.node_types(s, d).where("name = 'Tool'").select(F.col("id").alias("type_id"))
    hit = n.where("graph_name = 'ncx_shared__work_context' and not forgotten").join(F.broadcast(t), "type_id", "left_semi")
    return hit.orderBy(F.desc("importance"), F.desc("access_count"), "id").limit(20).select("id", "name", F.substring("content", 1, 200).alias("excerpt"))


def q16_inspect(s, d):
    n = V.nodes(s, d, "graph_name", "name", "forgotten")
    t = triples(V.edges(s, d), n.select("graph_name", "id", "name"), V.edge_types(s, d))
    out = t.where("lower(src) = 'hidden engine'").select("edge_id", F.lit("out").alias("direction"), "rel", F.col("tgt").alias("other"))
    inn = t.where("lower(tgt) = 'hidden engine'").select("edge_id", F.lit("in").alias("direction"), "rel", F.col("src").alias("other"))
    return out.unionByName(inn).orderBy("direction", "edge_id", "other").limit(20)


def q17_between(s, d):
    t = triples(V.edges(s, d), V.nodes(s, d, "graph_name", "name"), V.edge_types(s, d)).where("src is not null and tgt is not null")
    return t.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.count("*").alias("n_edges"), F.array_join(F.sort_array(F.collect_set("rel")), ",").alias("rels"))


def q18_listing(s, d):
    from ..operators.jobs import timeline

    j = V.jobs(s, d)
    t = timeline(j, V.job_events(j))
    sec = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return t.select("id", "status", F.round(sec, 3).alias("seconds")).where("finished_at is not null").orderBy(F.desc("id")).limit(100)


def q20_paths(s, d):
    """The domain tree: every domain with its path and the number of its children."""
    from ..operators import hierarchy as H
    from .integrity import records

    rec = cut(records(s, d).where("grp = 'domain'"))
    kids = rec.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    placed = H.hierarchy(rec, with_nodes=False).where("depth >= 0").join(kids, "node", "left")
    return placed.select(F.col("node").alias("node_key"), F.col("path").alias("full_path"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def q21_used_types(s, d):
    return _usage(s, d).where("n > 0").select("name", "n")


def q22_propose(s, d):
    asked = table(s, d, "ontology_classes").select(F.col("label").alias("asked")).distinct().where("asked is not null")
    p = asked.select("asked", T.node_type_name(F.col("asked")).alias("normal"))
    have = V.node_types(s, d).select(F.col("name").alias("have"))
    near = p.where("normal is not null").crossJoin(F.broadcast(have)).select("asked", "have", F.round(T.trigram_similarity(F.col("normal"), F.col("have")), 6).alias("sim")).where("sim > 0.2")
    best = near.groupBy("asked").agg(F.max_by("have", F.struct("sim", "have")).alias("most_similar"), F.max("sim").alias("sim"))
    return p.join(best, "asked", "left").select("asked", "normal", "most_similar", "sim", (F.col("normal").isNotNull() & (F.coalesce("sim", F.lit(0.0)) < 1)).alias("accepted"))


def v6_mmr(s, d):
    e = table(s, d, "embeddings")
    q = F.broadcast(e.where("vec_id in (0, 1)").select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("q")))
    from pyspark.sql import Window

    from ..functions import vectors as X

    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = e.crossJoin(q).select("query", "vec_id", "embedding", X.cosine(F.col("embedding"), F.col("q")).alias("score")).withColumn("r", F.row_number().over(w)).where("r <= 50")
    return R.mmr(top.withColumnRenamed("vec_id", "id")).select("query", "id", "rank")


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "qv" and k[1:2].isdigit()}
_TOK = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w in ('weekly', 'database'))"
_SUP = """, sx as (select source_id, target_id from e join et on et.id = e.type_id where et.name in ('SUPERSEDES', 'CORRECTS')),
  qv as (select min_by(embedding, id)::double[] as q from n where len(embedding) = 64),
  cand as (select n.*, case when len(embedding) = 64 then case when list_sum([x * x for x in embedding::double[]]) = 0 then 0 else list_cosine_similarity(embedding::double[], q) end end as vs,
    """ + _TOK.format("concat_ws(' ', name, content)") + """ as tk from n, qv where not forgotten),
  c2 as (select *, len(list_distinct(tk)) = 2 as hit, case when len(list_distinct(tk)) = 2 then round(len(tk)::double / (len(tk) + 1), 6) else 0 end as tr from cand),
  c3 as (select * from c2 where hit or vs > 0.5 order by tr desc, id limit 30),
  c4 as (select *, (coalesce(0.3 * vs, 0) + 0.2 * tr + coalesce(0.15 * """ + REC.format("greatest(created_at, updated_at)") + """, 0) + 0.2 * """ + ACT + """ + 0.15 * importance)
    / (case when vs is null then 0 else 0.3 end + case when greatest(created_at, updated_at) is null then 0 else 0.15 end + 0.55::double) as s0 from c3),
  ns as (select 'node' as kind, id, graph_name, name as label, round(s0 * case when id in (select target_id from sx where target_id is not null) then 0.5 when id in (select source_id from sx where source_id is not null) then 1.2 else 1.0 end, 6) as score from c4),
  ec as (select * from ep where contains(lower(content), 'weekly database') order by created_at desc, id desc limit 30),
  es as (select 'episode' as kind, id, graph_name, left(content, 80) as label, round((0.2 + 0.15 * """ + REC.format("created_at") + """) / 0.35::double, 6) as score from ec)
"""
_USE = ", us as (select nt.id, nt.name, count(n.id) as n from nt left join n on n.type_id = nt.id and not n.forgotten group by 1, 2)"
_TRI3 = """, tr as (select e.id as edge_id, e.graph_name, a.name as src, et.name as rel, b.name as tgt from e join et on et.id = e.type_id
      join n a on a.graph_name = e.graph_name and a.id = e.source_id join n b on b.graph_name = e.graph_name and b.id = e.target_id)"""
SQL = {
    "q2_merged": sql("n e et ep", _SUP + "select kind, id, score from (select * from ns union all select * from es) order by score desc, kind desc, id limit 10"),
    "q3_nodes": sql("n e et ep", _SUP + "select id, graph_name, score from ns"),
    "q1_recall": sql("n e et ep", _SUP + """, seeds as (select graph_name, id as seed, id as node, score as en from ns order by score desc, id limit 5),
      adj as (select graph_name, source_id as a, target_id as b, weight as w from e where weight > 0 and source_id is not null and target_id is not null union all select graph_name, target_id, source_id, weight from e where weight > 0 and source_id is not null and target_id is not null),
      l1 as (select s.graph_name, seed, b as node, max(en * w * 0.6) as en from seeds s join adj on adj.graph_name = s.graph_name and a = node where b <> seed group by 1, 2, 3),
      l2 as (select s.graph_name, seed, b as node, max(en * w * 0.6) as en from l1 s join adj on adj.graph_name = s.graph_name and a = node
        where b <> seed and not exists (select 1 from l1 x where x.graph_name = s.graph_name and x.seed = s.seed and x.node = b) group by 1, 2, 3),
      tot as (select graph_name, node, sum(en) as en from (select * from l1 union all select * from l2) group by 1, 2), bo as (select graph_name, node, en / (select max(en) from tot) as bonus from tot),
      it as (select * from ns union all select * from es)
      select it.kind, it.id, round(score + 0.1::double * coalesce(case when it.kind = 'node' then bonus end, 0), 6) as score from it left join bo on bo.graph_name = it.graph_name and bo.node = it.id and it.kind = 'node' order by 3 desc, 1 desc, 2 limit 10"""),
    "q3_episodes": sql("n e et ep", _SUP + """, sq as (select *, row_number() over (partition by agent_id, session_id order by created_at, id) as sqn from ep where session_id is not null),
      nb as (select b.id, round(max(es.score) * 0.6, 6) as score from es join sq a on a.id = es.id join sq b on a.agent_id is not distinct from b.agent_id and a.session_id = b.session_id and b.sqn between a.sqn - 1 and a.sqn + 2 and b.id <> a.id group by 1)
      select id, score, false as is_neighbour from es union all select id, score, true from nb where id not in (select id from es)"""),
    "q4_text_and_vector": sql("n", """, qv as (select min_by(embedding, id)::double[] as q from n where len(embedding) = 64),
      x as (select id, len(""" + _TOK.format("content") + """)::double as tf, case when len(embedding) = 64 then case when list_sum([x * x for x in embedding::double[]]) = 0 then 0 else round(list_cosine_similarity(embedding::double[], q), 5) end end as v from n, qv where not forgotten),
      a as (select id, tf / (tf + 1) as t from x where tf > 0 order by t desc, id limit 20), b as (select id, v from x where v is not null order by v desc, id limit 20)
      select coalesce(a.id, b.id) as id, round(t, 6) as text_rank, v as vector_sim from a full join b on a.id = b.id"""),
    "q5_recall": sql("n", f"""select id, name, round((coalesce(0.15 * {REC.format('created_at')}, 0) + 0.2 * {ACT} + 0.15 * importance) / (case when created_at is null then 0.35 else 0.5 end), 6) as score from n
      where not forgotten and (contains(lower(coalesce(name, '')), 'report') or contains(lower(coalesce(content, '')), 'report')) order by score desc, id limit 10"""),
    "q6_search": sql("n", ", x as (select id, case when contains(lower(name), 'garden') then 1.0::double when contains(lower(content), 'garden') then 0.5::double end as relevance from n where not forgotten) select * from x where relevance is not null order by relevance desc, id limit 100"),
    "q7_vector_neighbours": sql("n e", """, qv as (select min_by(embedding, id)::double[] as q from n where len(embedding) = 64),
      x as (select graph_name, id, case when list_sum([x * x for x in embedding::double[]]) = 0 then 0 else round(list_cosine_similarity(embedding::double[], q), 5) end as sim from n, qv where not forgotten and len(embedding) = 64 order by sim desc, id limit 5),
      f as (select * from e where source_id is not null and target_id is not null),
      adj as (select graph_name, source_id as a, target_id as b from f union select graph_name, target_id, source_id from f)
      select x.id, sim, coalesce(string_agg(distinct cast(b as varchar), ',' order by cast(b as varchar)), '') as neighbours from x left join adj on adj.graph_name = x.graph_name and a = x.id group by 1, 2"""),
    "q9_cascade": sql("n", f""", m as (select id, name from n where not forgotten and name is not null), qs as (select unnest(['HIDDEN ENGINE', 'weekly-database', 'Practical Servce', 'qqq zzz']) as query),
      ex as (select query, id, '1_exact' as match_type, 1.0::double as sim from qs join m on lower(query) = lower(name)), al as (select query, id, '2_alias' as match_type, 1.0::double as sim from qs join m on lower(query) = replace(lower(name), ' ', '-')),
      f0 as (select query, id, round({SIM.format(TRI.format('query'), TRI.format('name'))}, 6) as sim from qs, m where query not in (select query from ex union select query from al)),
      fz as (select query, id, '3_fuzzy' as match_type, sim from (select *, row_number() over (partition by query order by sim desc, id) as r from f0 where sim >= 0.3) where r <= 5),
      u as (select * from ex union all select * from al union all select * from fz) select distinct u.query, id, u.match_type, sim from u join (select query, min(match_type) as mt from u group by 1) k on k.query = u.query and k.mt = u.match_type"""),
    "q10_similar_types": sql("n nt", _USE + f", x as (select nt.name, round({tri_sim('nt.name', chr(39) + 'Persons' + chr(39))}, 6) as sim, us.n as n_live, description from nt join us on us.id = nt.id) select name, sim, n_live from x where sim > 0.2 or contains(lower(name), 'son') or contains(lower(coalesce(description, '')), 'persons') order by sim desc, name limit 10"),
    "q11_summary": sql("n nt", _USE + "select name, n, cast((select sum(n) from us) as bigint) as total, (select count(*) from us) as n_types from us"),
    "q12_edge_usage": sql("e et", "select et.name, count(e.id) as n, round(avg(e.weight), 4) as mean_weight from et left join e on e.type_id = et.id group by et.id, et.name"),
    "q13_type_detail": sql("n nt e", _USE + """, f as (select * from e where source_id is not null and target_id is not null), en as (select graph_name, source_id as id, type_id as t from f union all select graph_name, target_id, type_id from f),
      cn as (select n.type_id, count(distinct t) as c from n join en on en.graph_name = n.graph_name and en.id = n.id where n.type_id is not null group by 1),
      r as (select type_id, name, row_number() over (partition by type_id order by importance desc, id) as r from n where not forgotten and name is not null and type_id is not null), sm as (select type_id, string_agg(name, '|' order by r) as samples from r where r <= 3 group by 1)
      select us.name, us.n, coalesce(c, 0) as n_edge_types, samples from us left join cn on cn.type_id = us.id left join sm on sm.type_id = us.id"""),
    "q15_browse": sql("n nt", "select id, name, left(content, 200) as excerpt from n where graph_name = 'ncx_shared__work_context' and not forgotten and type_id = (select id from nt where name = 'Tool') order by importance desc, access_count desc, id limit 20"),
    "q16_inspect": sql("n e et", _TRI3 + "select * from (select edge_id, 'out' as direction, rel, tgt as other from tr where lower(src) = 'hidden engine' union all select edge_id, 'in', rel, src from tr where lower(tgt) = 'hidden engine') order by direction, edge_id, other nulls first limit 20"),
    "q17_between": sql("n e et", _TRI3 + "select least(src, tgt) as a, greatest(src, tgt) as b, count(*) as n_edges, string_agg(distinct rel, ',' order by rel) as rels from tr where src is not null and tgt is not null group by 1, 2"),
    "q18_listing": sql("ep jb jv", """, t as (select id, status, (select max(jv.at) from jv where job_id = jb.id and type = 'started') as st, (select max(jv.at) from jv where job_id = jb.id and type in ('succeeded', 'failed')) as fi from jb)
      select id, status, round((epoch_us(fi) - epoch_us(st)) / 1e6::double, 3) as seconds from t where fi is not null order by id desc limit 100"""),
    "q22_propose": f"with z as ({_T3}), a as (select distinct label as asked, type_name as normal from ontology_classes c join z using (class_id) where label is not null), h as (select asked, t.name as have, round({tri_sim('normal', 't.name')}, 6) as sim from a cross join graph_node_types t where normal is not null),"
    " b as (select asked, max_by(have, (sim, have)) as most_similar, max(sim) as sim from h where sim > 0.2 group by 1) select asked, normal, most_similar, sim, normal is not null and coalesce(sim, 0) < 1 as accepted from a left join b using (asked)",
    "q20_paths": _P1 + """select k as node_key, path as full_path, (select count(*) from lk c where c.tree = 'domain' and c.p = alls.k) as n_children from alls where tree = 'domain' and depth >= 0""",
    "q21_used_types": sql("n nt", _USE + "select name, n from us where n > 0"),
}
