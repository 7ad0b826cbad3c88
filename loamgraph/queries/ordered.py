"""Windows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vectors as X
from ..operators import sessions
from ..runtime import table
from ..views import AS_OF, sql
from .filters import tri_sim
from .scalars import REC


def examples_per_type(nodes, k: int):
    """(type_id, name, r): the k most important live named nodes of each type; ties by id. Groups are cut before the shuffle."""
    w = Window.partitionBy("type_id").orderBy(F.desc("importance"), "id")
    return nodes.where("not forgotten and name is not null and type_id is not null").select("type_id", "name", F.row_number().over(w).alias("r")).where(F.col("r") <= k)


def _eps(s, d):
    return V.event_episodes(s, d)


def w0_share(s, d):
    n = V.nodes(s, d, "graph_name").groupBy("graph_name").agg(F.count("*").alias("n"))
    return n.select("graph_name", "n", F.round(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)), 6).alias("share"))


def w1_sequence(s, d):
    return sessions.with_sequence(_eps(s, d)).select("id", "session_sequence")


def w2_predecessor(s, d):
    return sessions.with_previous(_eps(s, d)).select("id", "prev_id")


def w3_neighbours(s, d):
    e = _eps(s, d)
    return sessions.neighbours(e, e.select("id"), 3).select("id", "neighbour_id", "offset")


def w4_first_node(s, d):
    n = V.nodes(s, d, "properties", "created_at").select(F.col("id").alias("node_id"), "created_at", F.element_at("properties", "_source_episode").try_cast("bigint").alias("episode_id")).where("episode_id is not null")
    return n.groupBy("episode_id").agg(F.min_by("node_id", F.struct("created_at", "node_id")).alias("node_id"))


def w5_newest_per_type(s, d):
    n = V.nodes(s, d, "type_id", "created_at").where("type_id is not null")
    w = Window.partitionBy("type_id").orderBy(F.desc("created_at"), "id")
    return n.select("type_id", "id", F.row_number().over(w).cast("bigint").alias("r")).where("r <= 3")


def _ranked_eps(s, d):
    e = V.episodes(s, d).where("content is not null")
    score = F.round(S.recency(F.col("created_at"), AS_OF) * (1 + F.length("content") / 10000), 6)
    return e.select("id", "session_id", "created_at", score.alias("score"))


def w6_clusters(s, d):
    return sessions.clustered(_ranked_eps(s, d).orderBy(F.desc("score"), "id").limit(60)).select("id", "position")


def w7_keep_first(s, d):
    n = V.nodes(s, d, "graph_name", "name", "importance").where("name is not null")
    w = Window.partitionBy("graph_name", F.lower("name")).orderBy(F.desc("importance"), "id")
    return n.select("id", "graph_name", F.row_number().over(w).alias("r")).where("r = 1").drop("r")


def w8_overfetch(s, d):
    e = table(s, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 7").select(F.col("embedding").alias("q")))
    scored = e.crossJoin(q).where("vec_id <> 7").select("vec_id", "label", F.round(X.cosine(F.col("embedding"), F.col("q")), 5).alias("sim"))
    pool = scored.orderBy(F.desc("sim"), "vec_id").limit(30)
    w = Window.partitionBy("label").orderBy(F.desc("sim"), "vec_id")
    return pool.select("vec_id", "label", "sim", F.row_number().over(w).alias("r")).where("r <= 2").orderBy(F.desc("sim"), "vec_id").limit(10).select("vec_id", "sim")


def w10_first_three(s, d):
    n = V.nodes(s, d, "graph_name", "importance").where("graph_name is not null")
    w = Window.partitionBy("graph_name").orderBy(F.desc("importance"), "id")
    return n.select("id", F.row_number().over(w).alias("r")).where("r <= 3").select("id")


def j20_window_join(s, d):
    e = sessions.with_sequence(_eps(s, d))
    a = e.select("agent_id", "session_id", F.col("id").alias("nucleus"), F.col("session_sequence").alias("at"))
    near = e.join(a, ["agent_id", "session_id"]).where((F.col("session_sequence") >= F.col("at") - 1) & (F.col("session_sequence") <= F.col("at") + 2) & (F.col("id") != F.col("nucleus")))
    return near.select("nucleus", "id", (F.col("session_sequence") - F.col("at")).cast("bigint").alias("offset"))


def o1_page(s, d):
    return V.nodes(s, d, "created_at", "name").orderBy(F.desc("created_at"), F.desc("id")).offset(20).limit(20).select("id", "name")


def o2_important(s, d):
    return V.nodes(s, d, "importance", "access_count").orderBy(F.desc("importance"), F.desc("access_count"), "id").limit(50).select("id")


def o3_nearest(s, d):
    e = table(s, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return e.crossJoin(q).where("vec_id <> 0").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("q")), 5).alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(10)


def o4_text_top(s, d):
    r = T.text_rank(T.tokens(F.col("content")), T.tokens(F.lit("weekly database cooling")))
    return V.nodes(s, d, "content").select("id", F.round(r, 6).alias("rank")).orderBy(F.desc_nulls_last("rank"), "id").limit(25)


def o5_best_signal(s, d):
    n = V.nodes(s, d, "name", "content").where("name is not null")
    r = F.greatest(T.text_rank(T.tokens(F.col("content")), T.tokens(F.lit("weekly database"))), T.trigram_similarity(F.col("name"), F.lit("weekly database")))
    return n.select("id", F.round(r, 6).alias("score")).orderBy(F.desc("score"), "id").limit(25)


def o6_fuzzy_top(s, d):
    sim = F.round(T.trigram_similarity(F.col("name"), F.lit("Hidden Egnine")), 6)
    return V.nodes(s, d, "name", "forgotten").where("name is not null and not forgotten").select("id", sim.alias("sim")).where("sim >= 0.3").orderBy(F.desc("sim"), "id").limit(10)


def o7_session_order(s, d):
    return sessions.with_sequence(V.episodes(s, d).select("id", "agent_id", "session_id", "created_at")).orderBy(F.desc_nulls_last("session_sequence"), F.desc("created_at"), F.desc("id")).limit(40).select("id", "session_sequence")


def o9_truncate(s, d):
    e = _eps(s, d)
    top = e.orderBy(F.desc("created_at"), F.desc("id")).limit(10)
    near = sessions.neighbours(e, top.select("id"), 3).select(F.col("neighbour_id").alias("id"), F.lit(True).alias("is_neighbour"))
    prim = top.select("id", F.lit(False).alias("is_neighbour"))
    return prim.unionByName(near.join(prim.select("id"), "id", "left_anti").distinct())


def o10_names(s, d):
    return V.nodes(s, d, "name", "forgotten").where("not forgotten and name is not null").select("name").distinct().orderBy("name").limit(500)


def o11_priority(s, d):
    from .access import registry

    r = registry(s, d)
    w = Window.orderBy(F.when(F.col("purpose") == "personal", 0).otherwise(1), "purpose", "graph_name")
    return r.select("graph_name", F.row_number().over(w).cast("bigint").alias("nr"))


def o12_capped(s, d):
    n = V.nodes(s, d, "graph_name", "type_id").where("type_id is not null and graph_name is not null").groupBy("graph_name", "type_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("graph_name").orderBy(F.desc("n"), "type_id")
    return n.select("graph_name", "type_id", "n", F.row_number().over(w).alias("r")).where("r <= 3").drop("r")


QUERIES = {k: f for k, f in list(globals().items()) if (k[0] in "wo" and k[1:2].isdigit()) or k == "j20_window_join"}
_SEQ = ", sq as (select *, row_number() over (partition by agent_id, session_id order by created_at, id) as sqn from ev)"
_NEAR = "select a.id, b.id as neighbour_id, b.sqn - a.sqn as \"offset\" from sq a join sq b on a.agent_id is not distinct from b.agent_id and a.session_id = b.session_id and b.sqn between a.sqn - 1 and a.sqn + 2 and a.id <> b.id"
SQL = {
    "w0_share": sql("n", "select graph_name, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 6) as share from n group by 1"),
    "w1_sequence": sql("ev", _SEQ + " select id, sqn as session_sequence from sq"),
    "w2_predecessor": sql("ev", "select id, lag(id) over (partition by agent_id, session_id order by created_at, id) as prev_id from ev"),
    "w3_neighbours": sql("ev", _SEQ + _NEAR),
    "w4_first_node": sql("n", ", x as (select try_cast(properties['_source_episode'] as bigint) as episode_id, created_at, id from n) select episode_id, min_by(id, (created_at, id)) as node_id from x where episode_id is not null group by 1"),
    "w5_newest_per_type": sql("n", "select type_id, id, r from (select type_id, id, row_number() over (partition by type_id order by created_at desc nulls last, id) as r from n where type_id is not null) where r <= 3"),
    "w6_clusters": sql("ep", f""", x as (select id, session_id, created_at, round({REC.format('created_at')} * (1 + length(content) / 10000.0), 6) as score from ep where content is not null order by score desc, id limit 60),
      r as (select *, row_number() over (order by score desc, id) as r, coalesce(session_id, 'id ' || id) as k from x), c as (select *, min(r) over (partition by k) as c from r)
      select id, row_number() over (order by c, created_at, id) as position from c"""),
    "w7_keep_first": sql("n", "select id, graph_name from (select id, graph_name, row_number() over (partition by graph_name, lower(name) order by importance desc, id) as r from n where name is not null) where r = 1"),
    "w8_overfetch": """with s as (select a.vec_id, a.label, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as sim from embeddings a, embeddings b where b.vec_id = 7 and a.vec_id <> 7),
      p as (select * from s order by sim desc, vec_id limit 30), r as (select *, row_number() over (partition by label order by sim desc, vec_id) as r from p) select vec_id, sim from r where r <= 2 order by sim desc, vec_id limit 10""",
    "w10_first_three": sql("n", "select id from (select id, row_number() over (partition by graph_name order by importance desc, id) as r from n where graph_name is not null) where r <= 3"),
    "j20_window_join": sql("ev", _SEQ + _NEAR.replace("a.id, b.id as neighbour_id", "a.id as nucleus, b.id")),
    "o1_page": sql("n", "select id, name from n order by created_at desc nulls last, id desc limit 20 offset 20"),
    "o2_important": sql("n", "select id from n order by importance desc, access_count desc, id limit 50"),
    "o3_nearest": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as sim from embeddings a, embeddings b where b.vec_id = 0 and a.vec_id <> 0 order by sim desc, a.vec_id limit 10",
    "o4_text_top": sql("n", """, x as (select id, len(list_filter(string_split_regex(lower(coalesce(content, '')), '[^a-z0-9]+'), lambda w: w in ('weekly', 'database', 'cooling')))::double as tf from n)
      select id, round(tf / (tf + 1), 6) as rank from x order by rank desc, id limit 25"""),
    "o5_best_signal": sql("n", f""", x as (select id, name, len(list_filter(string_split_regex(lower(coalesce(content, '')), '[^a-z0-9]+'), lambda w: w in ('weekly', 'database')))::double as tf from n where name is not null)
      select id, round(greatest(tf / (tf + 1), {tri_sim('name', "'weekly database'")}), 6) as score from x order by score desc, id limit 25"""),
    "o6_fuzzy_top": sql("n", f", x as (select id, round({tri_sim('name', chr(39) + 'Hidden Egnine' + chr(39))}, 6) as sim from n where name is not null and not forgotten) select * from x where sim >= 0.3 order by sim desc, id limit 10"),
    "o7_session_order": sql("ep", ", x as (select id, created_at, case when session_id is not null then row_number() over (partition by agent_id, session_id order by created_at, id) end as session_sequence from ep) select id, session_sequence from x order by session_sequence desc nulls last, created_at desc, id desc limit 40"),
    "o9_truncate": sql("ev", _SEQ + ", top as (select id from ev order by created_at desc, id desc limit 10) select id, false as is_neighbour from top union all select distinct neighbour_id, true from (" + _NEAR + " where a.id in (select id from top)) where neighbour_id not in (select id from top)"),
    "o10_names": sql("n", "select distinct name from n where not forgotten and name is not null order by name limit 500"),
    "o11_priority": sql("n", ", rg as (select distinct graph_name, regexp_extract(graph_name, '__(.*)$', 1) as purpose from n where graph_name is not null) select graph_name, row_number() over (order by case when purpose = 'personal' then 0 else 1 end, purpose, graph_name) as nr from rg"),
    "o12_capped": sql("n", ", c as (select graph_name, type_id, count(*) as n from n where type_id is not null and graph_name is not null group by 1, 2), r as (select *, row_number() over (partition by graph_name order by n desc, type_id) as r from c) select graph_name, type_id, n from r where r <= 3"),
}
