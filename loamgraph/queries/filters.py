"""Scans, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import text as T
from ..functions import vectors as X
from ..runtime import table
from ..sources import files
from ..views import AS_OF, sql

GRAPH = "ncx_shared__work_context"
TERMS = "weekly report"


def s1_scan(s, d):
    return table(s, d, "graph_nodes").groupBy("source").agg(F.count("*").alias("n_rows"))


def s2_graph_scan(s, d):
    return V.nodes(s, d, "graph_name", "name").where(F.col("graph_name") == GRAPH).select("id", "name")


def s3_registered_scan(s, d):
    known = table(s, d, "ingest_requests").where("target_graph is not null").select(F.col("target_graph").alias("graph_name")).distinct()
    return V.nodes(s, d, "graph_name", "name").join(known, "graph_name", "left_semi").select("id", "graph_name")


def s4_role_scan(s, d):
    return V.nodes(s, d, "owner_role").where("owner_role = 'role_shared' or owner_role is null").select("id", "owner_role")


def s5_text_source(s, d):
    return files.text_episodes(table(s, d, "documents"), "doc_id", "text", "agent_id", "created_at").select("source_id", "agent_id", "n_chars", "content_hash")


def s6_document_source(s, d):
    return files.document_episodes(table(s, d, "documents")).select("doc_id", "extension", "n_bytes", "accepted")


def s7_event_source(s, d):
    return files.event_episodes(table(s, d, "events")).select("event_id", "agent_id", "content", "k")


def s9_hash_check(s, d):
    known = table(s, d, "ingest_results").select(files.normal_hash("content_hash").alias("hash")).where("hash is not null").distinct()
    asked = table(s, d, "hash_checks").select("check_id", F.explode("hashes").alias("h")).select("check_id", files.normal_hash("h").alias("hash")).where("hash is not null").distinct()
    return asked.join(known.withColumn("known", F.lit(True)), "hash", "left").select("check_id", "hash", F.when(F.col("known"), "existing").otherwise("missing").alias("state"))


def s12_media_text(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Source: "), "source"), F.concat(F.lit("Format: "), "doc_format")).alias("header"))


def s15_report(s, d):
    p = V.domains(s, d)
    line = F.concat(F.lit("- "), F.repeat(F.lit("  "), F.greatest(F.lit(0), F.least(F.col("depth"), F.lit(10)))), "slug", F.lit(" ("), F.coalesce("created_by", F.lit("?")), F.lit(")"))
    return p.select("id", line.alias("line"))


def s17_blocks(s, d):
    ep = V.episodes(s, d).where("session_id is not null")
    per = ep.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "id"))).alias("x"))
    return per.select("session_id", F.array_join(F.transform("x", lambda y: F.concat(F.lit("episode "), y["id"].cast("string"))), "\n---\n").alias("block"))


def s19_type_context(s, d):
    from .ordered import examples_per_type

    ex = examples_per_type(V.nodes(s, d, "type_id", "name", "importance", "forgotten"), 3)
    names = ex.groupBy("type_id").agg(F.sort_array(F.collect_list(F.struct("r", "name"))).alias("x"))
    t = V.node_types(s, d).select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    return t.join(F.broadcast(names), "type_id", "left").select("type_name", F.concat(F.lit("- "), "type_name", F.lit(": "), F.coalesce(F.array_join(F.transform("x", lambda y: y["name"]), ", "), F.lit("no examples"))).alias("line"))


def s21_strip_markup(s, d):
    t = F.regexp_replace(F.regexp_replace("text", r"[#*`>_\-]+", " "), r"\s+", " ")
    return table(s, d, "documents").where("doc_format = 'markdown'").select("doc_id", F.trim(t).alias("plain"))


def f1_point(s, d):
    n = V.nodes(s, d, "name", "type_id")
    first = n.agg(F.min("id").alias("id"))
    return n.join(F.broadcast(first), "id").select("id", "name", "type_id")


def f2_by_name(s, d):
    return V.node_types(s, d).where("name = 'Person'").select("id", "name")


def f3_name_ci(s, d):
    return V.nodes(s, d, "name", "forgotten").where("lower(name) = lower('HIDDEN ENGINE') and not forgotten").select("id", "name")


def f4_live(s, d):
    return V.nodes(s, d, "forgotten", "graph_name").where("not forgotten").groupBy("graph_name").agg(F.count("*").alias("n_live"))


def f5_in_list(s, d):
    wanted = table(s, d, "ingest_results").where("status = 'stored'").select(F.col("request_id").alias("id"))
    return V.episodes(s, d).join(wanted, "id", "left_semi").select("id", "agent_id")


def f6_not_in(s, d):
    bad = table(s, d, "ingest_results").where("request_id is not null").select(F.col("request_id").alias("id"))
    return V.episodes(s, d).join(bad, "id", "left_anti").select("id", "batch_no")


def f7_substring(s, d):
    return V.episodes(s, d).where(T.contains_ci(F.col("content"), F.lit("SPARE Wheel"))).select("id", "agent_id")


def f8_all_terms(s, d):
    q = T.tokens(F.lit(TERMS))
    doc = T.tokens(F.concat_ws(" ", "name", "content"))
    return V.nodes(s, d, "name", "content").where(T.matches_all(doc, q)).select("id", "name")


def f9_vector_threshold(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    dist = 1 - X.cosine(F.col("embedding"), F.col("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(dist, 6).alias("distance")).where("distance < 0.9")


def f10_trigram_threshold(s, d):
    sim = T.trigram_similarity(F.col("name"), F.lit("Practical Service"))
    return V.nodes(s, d, "name").where("name is not null").select("id", "name", F.round(sim, 6).alias("sim")).where("sim >= 0.3")


def f11_regex(s, d):
    return V.nodes(s, d, "name").where(F.col("name").rlike("^[A-Z]+-[0-9]+$") & ~F.col("name").rlike("(?i)^prototype")).select("id", "name")


def f12_map_key(s, d):
    n = V.nodes(s, d, "properties")
    return n.where(F.element_at("properties", "_source_episode").isNotNull()).select("id", F.element_at("properties", "_source_episode").alias("episode"))


def f13_has_key(s, d):
    return V.nodes(s, d, "properties").where(F.map_contains_key("properties", "confidence")).select("id", F.element_at("properties", "confidence").cast("double").alias("confidence"))


def f14_idle(s, d):
    n = V.nodes(s, d, "last_accessed_at", "forgotten")
    return n.where(f"not forgotten and last_accessed_at < timestamp '{AS_OF}' - interval 30 days").select("id", "last_accessed_at")


def listing(ep, agent: str | None = None, batch: int | None = None):
    """Optional filters: a parameter that is None does not restrict."""
    if agent is not None:
        ep = ep.where(F.col("agent_id") == agent)
    return ep if batch is None else ep.where(F.col("batch_no") == batch)


def f15_optional(s, d):
    return listing(V.episodes(s, d), agent="agent_atlas").select("id", "batch_no")


def f16_keyset(s, d):
    key = V.episodes(s, d).agg(F.max(F.struct("created_at", "id")).alias("k"))
    ep = V.episodes(s, d).crossJoin(F.broadcast(key))
    return ep.where(F.struct("created_at", "id") < F.col("k")).orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "created_at")


def f17_used_types(s, d):
    live = V.nodes(s, d, "type_id", "forgotten").where("not forgotten")
    return V.node_types(s, d).alias("t").join(live.alias("n"), F.col("t.id") == F.col("n.type_id"), "left_semi").select("id", "name")


def f18_empty_types(s, d):
    """Per graph the types that none of its nodes has."""
    n = V.nodes(s, d, "type_id", "graph_name").where("graph_name is not null").select("graph_name", F.col("type_id").alias("id")).distinct()
    every = n.select("graph_name").distinct().crossJoin(F.broadcast(V.node_types(s, d).select("id", "name")))  # the type list is fixed
    return every.join(n, ["graph_name", "id"], "left_anti").select("graph_name", "id", "name")


def f19_gravity_wells(s, d):
    n = V.nodes(s, d, "access_count", "name")
    lim = n.agg((F.avg("access_count") + 2 * F.stddev_samp("access_count")).alias("lim"))
    return n.crossJoin(F.broadcast(lim)).where("access_count > lim").select("id", F.col("access_count").cast("bigint").alias("access_count"))


def f20_excerpt(s, d):
    return V.nodes(s, d, "content").select("id", F.substring("content", 1, 80).alias("excerpt"))


def f21_default(s, d):
    t = V.node_types(s, d).select(F.col("id").alias("type_id"), F.col("name").alias("t"))
    n = V.nodes(s, d, "type_id", "content").join(F.broadcast(t), "type_id", "left")
    return n.select("id", F.coalesce("t", F.lit("Untyped")).alias("type_name"), F.coalesce(F.length("content"), F.lit(0)).alias("n_chars"))


def f22_weight_buckets(s, d):
    w = F.col("weight")
    b = F.when(w.isNull(), "none").when(w < 0, "negative").when(w < 0.5, "weak").when(w < 1.0, "medium").when(w < 1.5, "strong").otherwise("ceiling")
    return V.edges(s, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def f23_confident(s, d):
    n = V.nodes(s, d, "properties").select("id", F.element_at("properties", "confidence").try_cast("double").alias("confidence"))
    return n.where("confidence >= 0.3")


def f24_clamped(s, d):
    n = F.greatest(F.lit(1), F.least(F.size("hashes"), F.lit(100)))
    return table(s, d, "hash_checks").select("check_id", n.alias("n"))


def f25_like(s, d):
    return V.nodes(s, d, "name").where(F.lower("name").like("%service%")).select("id", "name")


def f26_histogram(s, d):
    e = V.edges(s, d).where("weight is not null")
    return e.groupBy(F.expr("width_bucket(weight, 0, 2, 20)").cast("bigint").alias("bucket")).agg(F.count("*").alias("n"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.round(F.avg("weight"), 6).alias("mean"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "sf" and k[1:2].isdigit()}
_H = "nullif(lower(regexp_extract(x, '([0-9A-Fa-f]{64})', 1)), '')"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOK = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> '' and w not in (" + STOP + "))"
TRI = "list_distinct(flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, len(w) + 2)] for w in string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+') if w <> '']))"
SIM = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::double"


def tri_sim(a: str, b: str) -> str:
    return SIM.format(TRI.format(a), TRI.format(b))


SQL = {
    "s1_scan": "select source, count(*) as n_rows from graph_nodes group by 1",
    "s2_graph_scan": sql("n", f"select id, name from n where graph_name = '{GRAPH}'"),
    "s3_registered_scan": sql("n", "select id, graph_name from n where graph_name in (select target_graph from ingest_requests where target_graph is not null)"),
    "s4_role_scan": sql("n", "select id, owner_role from n where owner_role = 'role_shared' or owner_role is null"),
    "s5_text_source": "select doc_id as source_id, agent_id, length(text) as n_chars, sha256(text) as content_hash from documents where text is not null",
    "s6_document_source": """select doc_id, case doc_format when 'markdown' then 'md' when 'events' then 'json' else 'txt' end as extension, coalesce(octet_length(encode(text)), 0) as n_bytes,
      coalesce(octet_length(encode(text)), 0) between 1 and 10485760 as accepted from documents""",
    "s7_event_source": """select event_id, 'agent_' || user_id as agent_id, event_type || ' ' || props as content, cast(props->>'$.k' as bigint) as k from events""",
    "s9_hash_check": f"""with known as (select distinct {_H.replace('x,', 'content_hash,')} as h from ingest_results),
      asked as (select distinct check_id, {_H} as h from (select check_id, unnest(hashes) as x from hash_checks))
      select check_id, h as hash, case when h in (select h from known where h is not null) then 'existing' else 'missing' end as state from asked where h is not null""",
    "s12_media_text": "select doc_id, concat_ws(chr(10), 'Title: ' || title, 'Source: ' || source, 'Format: ' || doc_format) as header from documents",
    "s15_report": sql("dom", "select id, '- ' || repeat('  ', greatest(0, least(depth, 10))) || slug || ' (' || coalesce(created_by, '?') || ')' as line from dom"),
    "s17_blocks": sql("ep", "select session_id, string_agg('episode ' || id, chr(10) || '---' || chr(10) order by created_at, id) as block from ep where session_id is not null group by 1"),
    "s19_type_context": sql("n nt", """, r as (select type_id, name, row_number() over (partition by type_id order by importance desc, id) as r from n where not forgotten and name is not null),
      x as (select type_id, string_agg(name, ', ' order by r) as names from r where r <= 3 group by 1)
      select nt.name as type_name, '- ' || nt.name || ': ' || coalesce(names, 'no examples') as line from nt left join x on x.type_id = nt.id"""),
    "s21_strip_markup": r"select doc_id, trim(regexp_replace(regexp_replace(text, '[#*`>_\-]+', ' ', 'g'), '\s+', ' ', 'g')) as plain from documents where doc_format = 'markdown'",
    "f1_point": sql("n", "select id, name, type_id from n where id = (select min(id) from n)"),
    "f2_by_name": "select id, name from graph_node_types where name = 'Person'",
    "f3_name_ci": sql("n", "select id, name from n where lower(name) = 'hidden engine' and not forgotten"),
    "f4_live": sql("n", "select graph_name, count(*) as n_live from n where not forgotten group by 1"),
    "f5_in_list": sql("ep", "select id, agent_id from ep where id in (select request_id from ingest_results where status = 'stored')"),
    "f6_not_in": sql("ep", "select id, batch_no from ep where id not in (select request_id from ingest_results where request_id is not null)"),
    "f7_substring": sql("ep", "select id, agent_id from ep where contains(lower(content), 'spare wheel')"),
    "f8_all_terms": sql("n", f", t as (select id, name, {TOK.format('concat_ws(chr(32), name, content)')} as t from n) select id, name from t where list_has_all(t, ['weekly', 'report'])"),
    "f9_vector_threshold": """with q as (select embedding::double[] as q from embeddings where vec_id = 0),
      x as (select vec_id, round(1 - list_cosine_similarity(embedding::double[], q), 6) as distance from embeddings, q) select * from x where distance < 0.9""",
    "f10_trigram_threshold": sql("n", f", x as (select id, name, round({tri_sim('name', chr(39) + 'Practical Service' + chr(39))}, 6) as sim from n where name is not null) select * from x where sim >= 0.3"),
    "f11_regex": sql("n", "select id, name from n where regexp_matches(name, '^[A-Z]+-[0-9]+$') and not regexp_matches(name, '(?i)^prototype')"),
    "f12_map_key": sql("n", "select id, properties['_source_episode'] as episode from n where properties['_source_episode'] is not null"),
    "f13_has_key": sql("n", "select id, cast(properties['confidence'] as double) as confidence from n where map_contains(properties, 'confidence')"),
    "f14_idle": sql("n", f"select id, last_accessed_at from n where not forgotten and last_accessed_at < timestamp '{AS_OF}' - interval 30 days"),
    "f15_optional": sql("ep", "select id, batch_no from ep where agent_id = 'agent_atlas'"),
    "f16_keyset": sql("ep", "select id, created_at from ep where (created_at, id) < (select (max(created_at), max_by(id, (created_at, id))) from ep) order by created_at desc, id desc limit 50"),
    "f17_used_types": sql("n nt", "select id, name from nt where exists (select 1 from n where n.type_id = nt.id and not forgotten)"),
    "f18_empty_types": sql("n nt", ", gs as (select distinct graph_name from n where graph_name is not null) select graph_name, id, name from gs, nt where id not in (select type_id from n where type_id is not null and n.graph_name = gs.graph_name)"),
    "f19_gravity_wells": sql("n", "select id, cast(access_count as bigint) as access_count from n where access_count > (select avg(access_count) + 2 * stddev_samp(access_count) from n)"),
    "f20_excerpt": sql("n", "select id, left(content, 80) as excerpt from n"),
    "f21_default": sql("n nt", "select n.id, coalesce(nt.name, 'Untyped') as type_name, cast(coalesce(length(content), 0) as integer) as n_chars from n left join nt on nt.id = n.type_id"),
    "f22_weight_buckets": sql("e", """select case when weight is null then 'none' when weight < 0 then 'negative' when weight < 0.5 then 'weak' when weight < 1.0 then 'medium' when weight < 1.5 then 'strong' else 'ceiling' end as bucket,
      count(*) as n from e group by 1"""),
    "f23_confident": sql("n", ", x as (select id, try_cast(properties['confidence'] as double) as confidence from n) select * from x where confidence >= 0.3"),
    "f24_clamped": "select check_id, cast(greatest(1, least(len(hashes), 100)) as integer) as n from hash_checks",
    "f25_like": sql("n", "select id, name from n where lower(name) like '%service%'"),
    "f26_histogram": sql("e", """select case when weight < 0 then 0 when weight >= 2 then 21 else cast(floor(20 * weight / 2.0) as bigint) + 1 end as bucket,
      count(*) as n, min(weight) as least, max(weight) as most, round(avg(weight), 6) as mean from e where weight is not null group by 1"""),
}
