"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import graph as G
from ..views import sql

_SEEDED = "graph_name = 'ncx_shared__work_context'"


def n1_strongest_out(s, d):
    from pyspark.sql import Window

    e = V.edges(s, d).where("source_id is not null and weight is not null")
    w = Window.partitionBy("graph_name", "source_id").orderBy(F.desc("weight"), "id")
    return e.select("graph_name", "source_id", "id", F.row_number().over(w).alias("r")).where("r <= 3").drop("r")


def n2_neighbours(s, d):
    n = V.nodes(s, d, "graph_name", "name")
    t = V.edge_types(s, d).select(F.col("id").alias("type_id"), F.col("name").alias("rel"))
    x = G.both_ways(V.edges(s, d)).join(F.broadcast(t), "type_id").join(n.select("graph_name", F.col("id").alias("nbr"), "name"), ["graph_name", "nbr"])
    return x.select("graph_name", "node", "nbr", "edge_id", "direction", "rel", "name")


def n3_neighbourhood(s, d):
    e = V.edges(s, d)
    seeds = V.nodes(s, d, "graph_name").where(_SEEDED).select("graph_name", "id")
    return G.neighbourhood(seeds, e, 2).select("seed", "node", "distance")


def n4_adjacency(s, d):
    adj = G.both_ways(V.edges(s, d)).where("weight is not null")
    return adj.groupBy("graph_name", "node").agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 4).alias("strength"))


def n5_spreading(s, d):
    seeds = V.nodes(s, d, "graph_name", "importance").where(_SEEDED + " and importance > 0.8").select("graph_name", "id", F.col("importance").alias("score"))
    return G.spreading_activation(seeds, V.edges(s, d).where("weight > 0")).select("node", F.round("bonus", 5).alias("bonus"))


def _first_nodes(s, d):
    n = V.nodes(s, d, "properties", "created_at").select(F.col("id").alias("node_id"), "created_at", F.element_at("properties", "_source_episode").try_cast("bigint").alias("episode_id"))
    return n.where("episode_id is not null").groupBy("episode_id").agg(F.min_by("node_id", F.struct("created_at", "node_id")).alias("node_id"))


def n8_session_links(s, d):
    return G.session_links(V.event_episodes(s, d), _first_nodes(s, d)).select("source_id", "target_id", "weight")


def n9_cascade(s, d):
    gone = V.nodes(s, d, "graph_name", "forgotten").where("forgotten").select("graph_name", "id")
    return G.cascade_delete(V.edges(s, d), gone).groupBy("graph_name").agg(F.count("*").alias("n_edges"))


def n10_hubs(s, d):
    deg = G.both_ways(V.edges(s, d)).groupBy("graph_name", "node").agg(F.count("*").alias("degree"))
    lim = deg.agg((F.avg("degree") + 2 * F.stddev_samp("degree")).alias("lim"))
    return deg.crossJoin(F.broadcast(lim)).where("degree > lim").select("graph_name", "node", "degree")


QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "n" and k[1:2].isdigit()}
_ADJ = """, f as (select * from e where source_id is not null and target_id is not null),
  adj as (select graph_name, source_id as a, target_id as b, id as edge_id, type_id, weight as w, 'out' as direction from f union all select graph_name, target_id, source_id, id, type_id, weight, 'in' from f)"""
SQL = {
    "n1_strongest_out": sql("e", "select graph_name, source_id, id from (select graph_name, source_id, id, row_number() over (partition by graph_name, source_id order by weight desc, id) as r from e where source_id is not null and weight is not null) where r <= 3"),
    "n2_neighbours": sql("n e et", _ADJ + "select adj.graph_name, a as node, b as nbr, edge_id, direction, et.name as rel, n.name from adj join et on et.id = adj.type_id join n on n.graph_name = adj.graph_name and n.id = b"),
    "n3_neighbourhood": sql("n e", _ADJ + f""", sd as (select graph_name, id as seed from n where {_SEEDED}), l1 as (select distinct sd.graph_name, seed, b as node from sd join adj on adj.graph_name = sd.graph_name and a = seed where b <> seed),
      l2 as (select distinct l1.graph_name, seed, b as node from l1 join adj on adj.graph_name = l1.graph_name and a = node where b <> seed)
      select seed, node, cast(min(d) as bigint) as distance from (select seed, node, 1 as d from l1 union all select seed, node, 2 from l2) group by 1, 2"""),
    "n4_adjacency": sql("e", _ADJ + "select graph_name, a as node, count(*) as degree, round(sum(w), 4) as strength from adj where w is not null group by 1, 2"),
    "n5_spreading": sql("n e", _ADJ + f""", sd as (select graph_name, id as seed, importance as en from n where {_SEEDED} and importance > 0.8), ad as (select * from adj where w > 0),
      l1 as (select s.graph_name, seed, b as node, max(en * w * 0.6) as en from sd s join ad on ad.graph_name = s.graph_name and a = seed where b <> seed group by 1, 2, 3),
      l2 as (select s.graph_name, seed, b as node, max(en * w * 0.6) as en from l1 s join ad on ad.graph_name = s.graph_name and a = node where b <> seed and not exists (select 1 from l1 x where x.seed = s.seed and x.node = b) group by 1, 2, 3),
      t as (select node, sum(en) as en from (select node, en from l1 union all select node, en from l2) group by 1) select node, round(en / (select max(en) from t), 5) as bonus from t"""),
    "n8_session_links": sql("n ev", """, x as (select try_cast(properties['_source_episode'] as bigint) as episode_id, created_at, id from n), fn as (select episode_id, min_by(id, (created_at, id)) as node_id from x where episode_id is not null group by 1),
      pv as (select id, lag(id) over (partition by agent_id, session_id order by created_at, id) as prev_id from ev)
      select distinct a.node_id as source_id, b.node_id as target_id, 0.9::double as weight from pv join fn a on a.episode_id = pv.id join fn b on b.episode_id = pv.prev_id where a.node_id <> b.node_id"""),
    "n9_cascade": sql("n e", ", g as (select graph_name, id from n where forgotten) select e.graph_name, count(*) as n_edges from e where not exists (select 1 from g where g.graph_name = e.graph_name and (g.id = e.source_id or g.id = e.target_id)) group by 1"),
    "n10_hubs": sql("e", _ADJ + ", dg as (select graph_name, a as node, count(*) as degree from adj group by 1, 2) select * from dg where degree > (select avg(degree) + 2 * stddev_samp(degree) from dg)"),
}
