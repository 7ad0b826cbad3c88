"""Permissions, routing of agents and episodes, graph registry, steward."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as T
from ..operators import routing, steward
from ..runtime import table
from ..views import sql


def permissions(s, d):
    """Grants as the requests show them: an agent may read what it targeted, and write where it did so twice."""
    r = table(s, d, "ingest_requests").where("target_graph is not null and agent_id is not null").select("request_id", "agent_id", F.col("target_graph").alias("graph_name")).distinct()
    return r.groupBy("agent_id", "graph_name").agg(F.lit(True).alias("can_read"), (F.count("*") >= 2).alias("can_write"))


def registry(s, d):
    g = V.nodes(s, d, "graph_name").select("graph_name").distinct().where("graph_name is not null")
    owner = F.regexp_extract("graph_name", "^ncx_(.*?)__", 1)
    return g.select("graph_name", owner.alias("owner"), T.purpose(F.col("graph_name")).alias("purpose"), (owner == "shared").alias("is_shared"))


def agents(s, d):
    """Agents own the graphs of their family name; agent_atlas administers."""
    a = table(s, d, "ingest_requests").where("agent_id is not null").select("agent_id").distinct()
    return a.select("agent_id", F.concat(F.regexp_extract("agent_id", "^agent_([a-z]+)", 1), F.lit("0")).alias("owner"), (F.col("agent_id") == "agent_atlas").alias("is_admin"))


def r1_row_policy(s, d):
    me = "role_quill0"
    return V.nodes(s, d, "owner_role").select("id", (F.col("owner_role").isNull() | (F.col("owner_role") == me)).alias("can_select"), F.coalesce(F.col("owner_role") == me, F.lit(False)).alias("can_update"))


def r2_permissions(s, d):
    return permissions(s, d).select("agent_id", "graph_name", "can_read", "can_write")


def r3_grants(s, d):
    p = permissions(s, d)
    return p.groupBy("graph_name").agg(F.count("*").alias("n_readers"), F.count_if("can_write").alias("n_writers"))


def r4_readable(s, d):
    return routing.readable(registry(s, d), permissions(s, d), agents(s, d)).select("agent_id", "graph_name", F.col("priority").cast("bigint").alias("priority"))


def r5_routed(s, d):
    dom = registry(s, d).where("is_shared").select(F.col("purpose").alias("slug"), "graph_name")
    ep = V.episodes(s, d).where("content is not null").select("id", "agent_id", F.col("content").alias("text"))
    return routing.route(ep, dom, permissions(s, d)).select("id", "agent_id", "slug", "graph_name", "confidence")


def r6_seed_source(s, d):
    """A domain's schema is its own, else the nearest ancestor's."""
    return routing.inherited(V.domains(s, d).select("id", "parent_id", "schema_name"))


def r7_roles(s, d):
    return agents(s, d).select("agent_id", T.role_name(F.col("agent_id")).alias("role"))


def _health(s, d):
    return steward.health(V.nodes(s, d, "graph_name", "type_id", "forgotten"), V.edges(s, d), V.episodes(s, d))


def q19_health(s, d):
    return _health(s, d).select("graph_name", "n_live", "n_types", F.round("top_share", 6).alias("top_share"), "n_edges", "n_routed")


def q19_proposals(s, d):
    return steward.proposals(_health(s, d))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "rq" and k[1:2].isdigit()}
_PERM = "pm as (select agent_id, target_graph as graph_name, true as can_read, count(distinct request_id) >= 2 as can_write from ingest_requests where target_graph is not null and agent_id is not null group by 1, 2)"
_REG = """rg as (select graph_name, regexp_extract(graph_name, '^ncx_(.*?)__', 1) as owner, regexp_extract(graph_name, '__(.*)$', 1) as purpose, regexp_extract(graph_name, '^ncx_(.*?)__', 1) = 'shared' as is_shared
  from (select distinct graph_name from n where graph_name is not null))"""
_AG = "ag as (select distinct agent_id, regexp_extract(agent_id, '^agent_([a-z]+)', 1) || '0' as owner, agent_id = 'agent_atlas' as is_admin from ingest_requests where agent_id is not null)"
_HEALTH = """, c as (select graph_name, type_id, count(*) as n from n where graph_name is not null and not forgotten group by 1, 2),
  h as (select c.graph_name, cast(sum(n) as bigint) as n_live, count(type_id) as n_types, max(n) / sum(n)::double as top_share, any_value(coalesce(ne, 0)) as n_edges, any_value(coalesce(nr, 0)) as n_routed from c
  left join (select graph_name, count(*) as ne from e group by 1) x on x.graph_name = c.graph_name left join (select graph_name, count(*) as nr from ep where graph_name is not null group by 1) y on y.graph_name = c.graph_name group by 1)
"""
SQL = {
    "r1_row_policy": sql("n", "select id, owner_role is null or owner_role = 'role_quill0' as can_select, coalesce(owner_role = 'role_quill0', false) as can_update from n"),
    "r2_permissions": f"with {_PERM} select * from pm",
    "r3_grants": f"with {_PERM} select graph_name, count(*) as n_readers, count(*) filter (where can_write) as n_writers from pm group by 1",
    "r4_readable": sql("n", f""", {_PERM}, {_REG}, {_AG}, x as (
      select agent_id, graph_name, purpose from ag join rg on rg.owner = ag.owner and not is_shared
      union select agent_id, graph_name, purpose from pm join rg using (graph_name) where is_shared
      union select agent_id, graph_name, purpose from ag, rg where is_admin and is_shared)
      select agent_id, graph_name, cast(case when purpose = 'personal' then 0 else 1 end as bigint) as priority from x"""),
    "r6_seed_source": "with recursive " + V.SQL["dom"] + """, up as (select id, id as cur, schema_name, parent_id from dom
      union select up.id, dom.id, dom.schema_name, dom.parent_id from up join dom on dom.id = up.parent_id where up.schema_name is null) select id, max(schema_name) as schema_name from up group by 1""",
    "r7_roles": f"with {_AG} select agent_id, 'role_' || left(trim(regexp_replace(lower(agent_id), '[^a-z0-9]+', '_', 'g'), '_'), 46) as role from ag",
    "q19_health": sql("n e ep", _HEALTH + "select graph_name, n_live, n_types, round(top_share, 6) as top_share, n_edges, n_routed from h"),
    "q19_proposals": sql("n e ep", _HEALTH + "select graph_name, 'split' as proposal from h where n_live >= 10 and n_types >= 6 and top_share <= 0.4 union all select graph_name, 'retire' from h where n_routed <= 1 and (select max(n_routed) from h) > 0"),
}
from .scalars import SQL as _SCALAR  # noqa: E402

SQL["r5_routed"] = _SCALAR["t13_keywords"].replace("select id, slug, 0.8", f", {_PERM}, {_REG}, hit as (select id, agent_id, slug, 0.8", 1).replace("\n      , pm", ",\n      pm").replace("with ", f"with {V.SQL['n']},\n", 1) + ") select id, hit.agent_id, slug, rg.graph_name, confidence from hit join rg on rg.is_shared and rg.purpose = hit.slug join pm on pm.agent_id = hit.agent_id and pm.graph_name = rg.graph_name and can_write"
SQL["r5_routed"] = SQL["r5_routed"].replace("v(slug, words))\n      , pm as", "v(slug, words)), pm as")
