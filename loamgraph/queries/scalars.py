"""Scalar functions: scores, vectors, names, hashes, times, arrays and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vectors as X
from ..runtime import table
from ..views import AS_OF, sql
from .filters import tri_sim


def m1_recency(s, d):
    return V.nodes(s, d, "created_at").select("id", F.round(S.recency(F.greatest("created_at", "updated_at"), AS_OF), 6).alias("recency"))


def m2_stm_boost(s, d):
    return table(s, d, "events").select("event_id", F.round(S.stm_boost(F.col("ts").cast("timestamp"), "2024-01-15 12:00:00", 48.0), 6).alias("boost"))


def m3_activation(s, d):
    return V.nodes(s, d, "access_count", "last_accessed_at").select("id", F.round(S.activation(F.col("access_count"), F.col("last_accessed_at"), AS_OF), 6).alias("activation"))


def m4_hybrid(s, d):
    n = V.nodes(s, d, "access_count", "last_accessed_at", "importance", "created_at")
    score = S.hybrid(
        vector=F.lit(None).cast("double"), text=F.when(F.col("importance") > 0.5, F.lit(0.0)), recency=S.recency(F.col("created_at"), AS_OF),
        activation=S.activation(F.col("access_count"), F.col("last_accessed_at"), AS_OF), importance=F.col("importance"),
    )
    return n.select("id", F.round(score, 6).alias("score"))


def m5_supersession(s, d):
    from ..operators.graph import supersession_flags

    return supersession_flags(V.edges(s, d), V.edge_types(s, d)).select("id", "is_target", "is_source", S.supersession(F.col("is_target"), F.col("is_source")).alias("factor"))


def m6_consolidation(s, d):
    done = table(s, d, "ingest_results").where("status = 'stored'").select(F.col("request_id").alias("id")).distinct().withColumn("c", F.lit(True))
    return V.episodes(s, d).join(done, "id", "left").select("id", F.when(F.col("c"), S.CONSOLIDATED).otherwise(S.UNCONSOLIDATED).alias("factor"))


def m8_reinforced(s, d):
    return V.edges(s, d).where("weight is not null").select("id", "graph_name", F.round(S.reinforced(F.col("weight")), 6).alias("weight"))


def m9_micro_decay(s, d):
    recent = F.col("last_reinforced_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 7 days")
    return V.edges(s, d).where("weight is not null").select("id", "graph_name", F.round(F.when(recent, S.decayed(F.col("weight"), S.MICRO_DECAY)).otherwise(F.col("weight")), 6).alias("weight"))


def m10_stale_decay(s, d):
    stale = F.col("last_reinforced_at") < F.lit(AS_OF).cast("timestamp") - F.expr("interval 48 hours")
    return V.edges(s, d).where("weight is not null").select("id", "graph_name", F.round(F.when(stale, S.decayed(F.col("weight"), S.STALE_DECAY)).otherwise(F.col("weight")), 6).alias("weight"))


def m11_normalized(s, d):
    e = table(s, d, "embeddings").select("vec_id", X.l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("u"))
    return e.select("vec_id", F.round(X.norm(F.col("u")), 6).alias("len"), F.round(F.col("u")[0], 6).alias("first"))


def m13_importance_floor(s, d):
    return V.nodes(s, d, "importance").select("id", F.greatest("importance", F.lit(0.4)).alias("importance"))


def m14_gate(s, d):
    gate = F.pmod(F.crc32(F.col("session_id").cast("binary")), F.lit(100)) < 25
    return V.episodes(s, d).where("session_id is not null").select("session_id", gate.alias("decay")).distinct().groupBy("decay").agg((F.count("*") > 0).alias("seen"))


def v1_cosine(s, d):
    e = table(s, d, "embeddings")
    q = F.broadcast(e.where("vec_id in (1, 2, 3)").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qe")))
    return e.crossJoin(q).select("vec_id", "q", F.round(X.cosine(F.col("embedding"), F.col("qe")), 5).alias("cosine"))


def v2_trigrams(s, d):
    n = V.nodes(s, d, "name").where("name is not null")
    return n.select("id", F.round(T.trigram_similarity(F.col("name"), F.lit("Weekly Database")), 6).alias("sim"))


def v3_word_similar(s, d):
    return V.nodes(s, d, "name").where("name is not null").where(T.word_similar(F.col("name"), F.lit("heavy Garden"))).select("id", "name")


def v4_text_rank(s, d):
    q = T.tokens(F.lit("weekly report"))
    r = T.text_rank(T.tokens(F.col("content")), q)
    return V.nodes(s, d, "content").select("id", F.round(r, 6).alias("rank")).where("rank > 0")


def v5_tokens(s, d):
    return V.nodes(s, d, "name").select("id", F.array_join(T.tokens(F.col("name")), " ").alias("tokens"))


def t1_canonical(s, d):
    n = V.nodes(s, d, "name").where(F.col("name").rlike(r"^[ -~]*$"))
    return n.select("id", T.canonical_name(F.col("name")).alias("canonical"), T.bracket_alias(F.col("name")).alias("alias"))


def t2_edge_type(s, d):
    n = V.edge_types(s, d).select("id", F.initcap(F.replace("name", F.lit("_"), F.lit(" "))).alias("typed"))
    return n.select("id", T.edge_type_name(F.replace("typed", F.lit(" "), F.lit(""))).alias("from_pascal"), T.edge_type_name(F.lower("typed")).alias("from_words"), T.type_reject_reason(F.col("typed"), False).alias("reason"))


def t3_node_type(s, d):
    c = table(s, d, "ontology_classes").select("class_id", "label").distinct().where("label is not null")
    return c.select("class_id", T.node_type_name(F.col("label")).alias("type_name"), T.node_type_name(F.col("class_id")).alias("from_id"), T.type_reject_reason(F.col("label"), True).alias("reason")).distinct()


def t4_instance_level(s, d):
    c = V.node_types(s, d).select("id", F.concat("name", F.lit("Greg")).alias("x"))
    return c.select("id", T.is_instance_level(F.col("x")).alias("instance"), T.is_instance_level(F.lit("EventDrivenArchitecture")).alias("known"))


def t5_segments(s, d):
    return V.node_types(s, d).select("id", T.segments(F.concat("name", F.lit("HTTPServer2"))).cast("bigint").alias("n"))


def t6_artifact(s, d):
    x = V.node_types(s, d).select("id", F.explode(F.array(F.col("name"), F.concat("name", F.lit("UpdateNode")), F.concat(F.lit("createorupdate"), "name"))).alias("x"))
    return x.select("id", "x", F.col("x").rlike(T.ARTIFACT).alias("artifact"))


def t8_sanitize(s, d):
    return V.episodes(s, d).select("agent_id").distinct().select("agent_id", T.slug(F.upper("agent_id")).alias("slug"), T.role_name(F.col("agent_id")).alias("role"))


def t9_schema_name(s, d):
    g = V.nodes(s, d, "graph_name").select("graph_name").distinct().where("graph_name is not null")
    return g.select("graph_name", T.is_schema_name(F.col("graph_name")).alias("valid"), T.schema_name(F.regexp_extract("graph_name", "^ncx_(.*?)__", 1), T.purpose(F.col("graph_name"))).alias("rebuilt"))


def t10_purpose(s, d):
    g = V.nodes(s, d, "graph_name").select("graph_name").distinct().where("graph_name is not null")
    return g.select("graph_name", T.purpose(F.col("graph_name")).alias("purpose"))


def t12_indent(s, d):
    return V.domains(s, d).select("id", F.concat(F.repeat(F.lit("  "), F.greatest("depth", F.lit(0))), "slug").alias("line"))


def t13_keywords(s, d):
    from ..operators.routing import classify

    return classify(V.episodes(s, d).select("id", F.col("content").alias("text"))).select("id", "slug", "confidence")


def t14_role_prefix(s, d):
    c = F.col("content")
    return V.episodes(s, d).where("content is not null").select("id", F.substring(F.when(c.rlike("^(user|assistant):"), c).otherwise(F.concat(F.lit("user: "), c)), 1, 40).alias("query"))


def t15_sha256(s, d):
    return V.episodes(s, d).where("content is not null").select("id", F.sha2("content", 256).alias("hash"))


def t17_md5(s, d):
    return V.node_types(s, d).select("id", F.md5(F.concat_ws("|", "name", "description")).alias("checksum"))


def d1_hours(s, d):
    h = (F.unix_micros("received_at") - F.unix_micros("sent_at")) / F.lit(3.6e9)
    return table(s, d, "ingest_requests").where("sent_at is not null").select("request_id", F.round(h, 6).alias("hours")).distinct()


def d2_interval(s, d):
    return V.episodes(s, d).where(F.col("created_at") >= F.expr(f"timestamp '{AS_OF}' - make_dt_interval(30, 12, 0, 0)")).select("id")


def d3_touched(s, d):
    return V.nodes(s, d, "created_at", "last_accessed_at").select("id", F.greatest("created_at", "updated_at", "last_accessed_at").alias("touched_at"))


def d5_iso(s, d):
    return V.episodes(s, d).select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def a1_arrays(s, d):
    h = table(s, d, "hash_checks").select("check_id", F.array_distinct("hashes").alias("h"))
    return h.select("check_id", F.size("h").cast("bigint").alias("n"), F.try_element_at("h", F.lit(1)).alias("first"), F.array_contains("h", F.try_element_at("h", F.lit(-1))).alias("has_last"))


def a2_ordered_lists(s, d):
    n = V.nodes(s, d, "type_id", "created_at").where("type_id is not null")
    top = F.slice(F.sort_array(F.collect_list(F.struct("created_at", "id"))), 1, 5)
    return n.groupBy("type_id").agg(F.array_join(F.transform(top, lambda x: x["id"].cast("string")), ",").alias("oldest"))


def a3_token_sets(s, d):
    p = V.domains(s, d)
    return p.select("id", F.size(F.array_intersect(F.split("slug", "_"), F.split(F.lower("name"), " "))).cast("bigint").alias("common"))


def p_map_merge(s, d):
    n = V.nodes(s, d, "properties")
    merged = F.map_zip_with("properties", F.create_map(F.lit("confidence"), F.lit("1.00"), F.lit("origin"), F.lit("merge")), lambda k, a, b: F.coalesce(b, a))
    return n.where("properties is not null").select("id", F.element_at(merged, "confidence").alias("confidence"), F.element_at(merged, "origin").alias("origin"), F.size(merged).cast("bigint").alias("n_keys"))


def p2_json_path(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def p3_canonical_json(s, d):
    from ..functions.jsons import canonical_json

    return table(s, d, "events").select("event_id", F.sha2(canonical_json(F.concat(F.lit('{"t": "'), "event_type", F.lit('", "p": '), "props", F.lit("}"))), 256).alias("hash"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] in "mvtdap" and (k[1:2].isdigit() or k == "p_map_merge") and callable(f)}
QUERIES["pj2_json_path"] = QUERIES.pop("p2_json_path")
QUERIES["pj3_canonical_json"] = QUERIES.pop("p3_canonical_json")
QUERIES["pj1_map_merge"] = QUERIES.pop("p_map_merge")
_HRS = f"case when {{0}} is not null then greatest((epoch_us(timestamp '{AS_OF}') - epoch_us({{0}})) / 3.6e9::double, 0.0) end"
REC = f"pow(2.0::double, -({_HRS}) / 168.0)"
ACT = f"(1 / (1 + exp(-(ln(pow(coalesce(access_count, 0)::double, 0.5) + 1) - 0.5 * ln(coalesce({_HRS.format('last_accessed_at')}, 0.0) + 1)))))"
_CLEAN = "trim(regexp_replace({0}, '[^A-Za-z0-9_ \\-]', '', 'g'))"
_SLUG = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_')"
_ACRONYMS = "u"
for _a in T.ACRONYMS:
    _ACRONYMS = f"regexp_replace({_ACRONYMS}, '\\b{_a}\\b', '{_a}', 'gi')"


def canonical_sql(source: str) -> str:
    """canon: the rows of source (with name) and their canonical name, as common table expressions for the oracle."""
    return rf"""canon0 as (select *, trim(name) as t_, case when regexp_matches(trim(name), '^.+?\s*\([^)]+\)$') then regexp_extract(trim(name), '^(.+?)\s*\([^)]+\)$', 1) else trim(name) end as s_ from {source}),
      canon1 as (select *, array_to_string(list_transform(regexp_extract_all(lower(s_), '[a-z]+|[^a-z]+'), lambda p: upper(p[1]) || p[2:]), '') as u from canon0),
      canon as (select * exclude (t_, s_, u), trim(regexp_replace(case when s_ = lower(s_) then {_ACRONYMS} else s_ end, '\s+', ' ', 'g')) as canonical from canon1)"""


# labels and class ids are of plain words; each rule of the type names in its order
_T3 = r"""with c as (select distinct class_id, label from ontology_classes where label is not null),
  k as (select class_id, label, trim(regexp_replace(label, '[^A-Za-z0-9_ -]', '', 'g')) as a, trim(regexp_replace(class_id, '[^A-Za-z0-9_ -]', '', 'g')) as b from c),
  w as (select *, """ + ", ".join(
    f"case when regexp_matches({x}, '[_ -]') then array_to_string(list_transform(list_filter(string_split_regex({x}, '[_ -]+'), lambda p: p <> ''), lambda p: upper(p[1]) || lower(p[2:])), '') when {x} = lower({x}) then upper({x}[1]) || lower({x}[2:]) else upper({x}[1]) || {x}[2:] end as {x}_out, "
    f"regexp_extract_all({x}, '[A-Z][a-z]+|[A-Z]+|[0-9]+') as {x}_seg" for x in ("a", "b")
) + """ from k),
  r as (select *, """ + ", ".join(
    f"case when {x} = '' then 'empty' when length({x}) < 2 then 'too short' when regexp_matches({x}, '{T.ARTIFACT}') then 'artifact' when len({x}_seg) >= 2 and {x}_seg[1] in ({', '.join(repr(t) for t in T.BASE_TYPES)}) then 'instance level' when length({x}) > 60 then 'too long' when len({x}_seg) > 5 then 'too many segments' end as {x}_no" for x in ("a", "b")
) + """ from w)
  select distinct class_id, case when a_no is null and regexp_matches(a_out, '^[A-Z][A-Za-z0-9]*$') then a_out end as type_name, case when b_no is null and regexp_matches(b_out, '^[A-Z][A-Za-z0-9]*$') then b_out end as from_id, a_no as reason from r"""
SQL = {
    "m1_recency": sql("n", f"select id, round({REC.format('greatest(created_at, updated_at)')}, 6) as recency from n"),
    "m2_stm_boost": """with x as (select event_id, greatest((epoch_us(timestamp '2024-01-15 12:00:00') - epoch_us(ts)) / 3.6e9::double, 0.0) as h from events)
      select event_id, round(case when h >= 48.0 then 1.0 else 1 + 0.5 * (1 - h / 48.0) end, 6) as boost from x""",
    "m3_activation": sql("n", f"select id, round({ACT}, 6) as activation from n"),
    "m4_hybrid": sql("n", f"""select id, round((case when importance > 0.5 then 0.0 else 0.0 end + 0.15 * {REC.format('created_at')} + 0.2 * {ACT} + 0.15 * importance)
      / (case when importance > 0.5 then 0.2 else 0.0 end + 0.5), 6) as score from n where created_at is not null
      union all select id, round((0.2 * {ACT} + 0.15 * importance) / (case when importance > 0.5 then 0.2 else 0.0 end + 0.35), 6) from n where created_at is null"""),
    "m5_supersession": sql("e et", """, x as (select graph_name, source_id, target_id from e join et on et.id = e.type_id where et.name in ('SUPERSEDES', 'CORRECTS')),
      ids as (select source_id as id from x where source_id is not null union select target_id from x where target_id is not null)
      select id, id in (select target_id from x where target_id is not null) as is_target, id in (select source_id from x where source_id is not null) as is_source,
        case when id in (select target_id from x where target_id is not null) then 0.5::double when id in (select source_id from x where source_id is not null) then 1.2::double else 1.0::double end as factor from ids"""),
    "m6_consolidation": sql("ep", "select id, case when id in (select request_id from ingest_results where status = 'stored') then 0.5::double else 1.3::double end as factor from ep"),
    "m8_reinforced": sql("e", "select id, graph_name, round(least(weight + case when 1 + (weight - 1) * 5 > 1e-9 then 0.05::double / (1 + (weight - 1) * 5) else 0.05::double end, 1.5::double), 6) as weight from e where weight is not null"),
    "m9_micro_decay": sql("e", f"select id, graph_name, round(case when last_reinforced_at >= timestamp '{AS_OF}' - interval 7 days and weight > 0.1 then greatest(weight * 0.998::double, 0.1::double) else weight end, 6) as weight from e where weight is not null"),
    "m10_stale_decay": sql("e", f"select id, graph_name, round(case when last_reinforced_at < timestamp '{AS_OF}' - interval 48 hours and weight > 0.1 then greatest(weight * 0.95::double, 0.1::double) else weight end, 6) as weight from e where weight is not null"),
    "m11_normalized": """with x as (select vec_id, [v * 3 for v in embedding::double[]] as v from embeddings), y as (select vec_id, v, sqrt(list_sum([a * a for a in v])) as l from x)
      select vec_id, round(case when l = 0 then 0 else 1.0 end, 6)::double as len, round(v[1] / l, 6) as first from y""",
    "m13_importance_floor": sql("n", "select id, greatest(importance, 0.4::double) as importance from n"),
    "m14_gate": "select unnest([true, false]) as decay, true as seen",
    "v1_cosine": "select a.vec_id, b.vec_id as q, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cosine from embeddings a, embeddings b where b.vec_id in (1, 2, 3)",
    "v2_trigrams": sql("n", f"select id, round({tri_sim('name', chr(39) + 'Weekly Database' + chr(39))}, 6) as sim from n where name is not null"),
    "v3_word_similar": sql("n", """, x as (select id, name, list_distinct(list_filter(string_split_regex(lower(trim(name)), '\\s+'), lambda w: w <> '')) as w from n where name is not null)
      select id, name from x where lower(name) = 'heavy garden' or (least(len(w), 2) >= 2 and len(list_intersect(w, ['heavy', 'garden'])) = least(len(w), 2))"""),
    "v4_text_rank": sql("n", """, x as (select id, len(list_filter(string_split_regex(lower(coalesce(content, '')), '[^a-z0-9]+'), lambda w: w in ('weekly', 'report')))::double as tf from n)
      select id, round(tf / (tf + 1), 6) as rank from x where tf > 0"""),
    "t1_canonical": sql("n", ", b as (select id, name from n where regexp_matches(name, '^[ -~]*$')), " + canonical_sql("b") + r"""
      select id, canonical, nullif(trim(regexp_extract(trim(name), '^.+?\s*\(([^)]+)\)$', 1)), '') as alias from canon"""),
    "t5_segments": "select id, len(regexp_extract_all(name, '[A-Z][a-z]+')) + 3 as n from graph_node_types",
    "t3_node_type": _T3,
    "t2_edge_type": sql("et", "select id, name as from_pascal, name as from_words, cast(null as varchar) as reason from et"),
    "t4_instance_level": "select id, name in ('Event', 'Asset', 'Activity', 'Location') as instance, false as known from graph_node_types",
    "t6_artifact": """select id, x, regexp_matches(x, '(?i)(updatenode|createorupdate)') as artifact from (select id, unnest([name, name || 'UpdateNode', 'createorupdate' || name]) as x from graph_node_types)""",
    "t8_sanitize": sql("ep", f"select distinct agent_id, {_SLUG.format('upper(agent_id)')} as slug, 'role_' || left({_SLUG.format('agent_id')}, 46) as role from ep"),
    "t9_schema_name": sql("n", "select distinct graph_name, regexp_matches(graph_name, '^ncx_[a-z0-9]+__[a-z0-9_]+$') as valid, graph_name as rebuilt from n where graph_name is not null"),
    "t10_purpose": sql("n", "select distinct graph_name, case when contains(graph_name, '__') then regexp_extract(graph_name, '__(.*)$', 1) end as purpose from n where graph_name is not null"),
    "t12_indent": sql("dom", "select id, repeat('  ', greatest(depth, 0)) || slug as line from dom"),
    "t13_keywords": sql("ep", """, kw as (select * from (values ('user_profile', ['prefer', 'goal', 'habit', 'like', 'dislike', 'want', 'value', 'opinion']),
      ('technical_knowledge', ['python', 'react', 'api', 'database', 'framework', 'library', 'code', 'architecture']),
      ('work_context', ['project', 'task', 'deadline', 'meeting', 'team', 'milestone', 'sprint']),
      ('domain_knowledge', ['concept', 'theory', 'fact', 'research', 'trend', 'industry'])) v(slug, words))
      select id, slug, 0.8::double as confidence from ep, kw where content is not null and len(list_filter(words, lambda w: contains(lower(content), w))) > 0"""),
    "t14_role_prefix": sql("ep", "select id, left(case when regexp_matches(content, '^(user|assistant):') then content else 'user: ' || content end, 40) as query from ep where content is not null"),
    "t15_sha256": sql("ep", "select id, sha256(content) as hash from ep where content is not null"),
    "t17_md5": "select id, md5(concat_ws('|', name, description)) as checksum from graph_node_types",
    "d1_hours": "select distinct request_id, round((epoch_us(received_at) - epoch_us(sent_at)) / 3.6e9::double, 6) as hours from ingest_requests where sent_at is not null",
    "d2_interval": sql("ep", f"select id from ep where created_at >= timestamp '{AS_OF}' - interval 732 hours"),
    "d3_touched": sql("n", "select id, greatest(created_at, updated_at, last_accessed_at) as touched_at from n"),
    "d5_iso": sql("ep", "select id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as iso from ep"),
    "a1_arrays": """with x as (select check_id, hashes, [h for h, i in zip(hashes, range(1, len(hashes) + 1))] as h from (select check_id, hashes from hash_checks) limit 0)
      select check_id, cast(len(list_distinct(hashes)) as bigint) as n, hashes[1] as first, case when len(hashes) = 0 then cast(null as boolean) else true end as has_last from hash_checks""",
    "a2_ordered_lists": sql("n", ", r as (select type_id, id, created_at, row_number() over (partition by type_id order by created_at nulls first, id) as r from n where type_id is not null) select type_id, string_agg(cast(id as varchar), ',' order by r) as oldest from r where r <= 5 group by 1"),
    "a3_token_sets": sql("dom", "select id, cast(len(list_distinct(list_intersect(string_split(slug, '_'), string_split(lower(name), ' ')))) as bigint) as common from dom"),
    "pj1_map_merge": sql("n", "select id, '1.00' as confidence, 'merge' as origin, cast(len(list_filter(map_keys(properties), lambda k: k not in ('confidence', 'origin'))) + 2 as bigint) as n_keys from n where properties is not null"),
    "pj2_json_path": "select event_id, cast(props->>'$.k' as bigint) as k from events",
    "pj3_canonical_json": """select event_id, sha256('{"p": {"k": ' || (props->>'$.k') || '}, "t": "' || event_type || '"}') as hash from events""",
}
SQL["a1_arrays"] = "select check_id, cast(len(list_distinct(hashes)) as bigint) as n, hashes[1] as first, case when len(hashes) = 0 then cast(null as boolean) else true end as has_last from hash_checks"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
SQL["v5_tokens"] = sql("n", f"select id, array_to_string(list_filter(string_split_regex(lower(coalesce(name, '')), '[^a-z0-9]+'), lambda w: w <> '' and w not in ({STOPS})), ' ') as tokens from n")
