"""The memory graph's tables with repeated rows folded and defaults filled, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table

AS_OF = "2025-12-01 00:00:00"


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The row with the latest `at` per key (nulls first); max_by over a struct combines before the shuffle. Null keys are left out."""
    order = F.struct(F.col(at).isNotNull().alias("k"), F.col(at).alias("t"))
    tie = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(whole, F.struct(order, tie)).alias("row")).select("row.*")


def nodes(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per node; only the given columns, if any, are read besides key and time."""
    df = table(spark, d, "graph_nodes")
    if cols:
        df = df.select(*dict.fromkeys([*cols, "id", "updated_at"]))
    df = latest(df, "id", "updated_at")
    fill = {"access_count": F.lit(0), "importance": F.lit(0.5), "forgotten": F.lit(False)}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items() if c in df.columns})


def edges(spark: SparkSession, d: str) -> DataFrame:
    """One row per edge; exact repeated rows are folded on all columns but the property map, which repeats with them."""
    return table(spark, d, "graph_edges").dropDuplicates(["id", "graph_name", "source_id", "target_id", "type_id", "weight", "created_at"])


def node_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_node_types")


def edge_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_edge_types")


def domains(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "semantic_domains"), "id", "updated_at")


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Requests as episodes: (id, agent_id, content, session_id, graph_name, created_at, batch_no, force_flag)."""
    return table(spark, d, "ingest_requests").select(
        F.col("request_id").alias("id"), "agent_id", F.col("text").alias("content"), "session_id", F.col("target_graph").alias("graph_name"),
        F.col("received_at").alias("created_at"), "sent_at", "batch_no", "force_flag",
    ).distinct()


def event_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Events as episodes (id, agent_id, session_id, created_at): a user's events of one day are a session."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("agent_"), F.col("user_id").cast("string")).alias("agent_id"), F.date_format("ts", "yyyy-MM-dd").alias("session_id"), F.col("ts").alias("created_at")
    )


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """An extraction job per request: (id, task_name, status, queue_name, args as JSON, scheduled_at)."""
    res = table(spark, d, "ingest_results").select("request_id", F.col("status").alias("s"), "episodes_created").distinct()
    ep = episodes(spark, d)
    status = F.when(F.col("s") == "stored", "succeeded").when(F.col("s") == "failed", "failed").when(F.col("s") == "skipped", "cancelled").otherwise("todo")
    quoted = F.coalesce(F.concat(F.lit('"'), F.col("graph_name"), F.lit('"')), F.lit("null"))
    args = F.concat(F.lit('{"agent_id": "'), F.coalesce("agent_id", F.lit("")), F.lit('", "episode_ids": ['), F.col("id").cast("string"), F.lit('], "target_schema": '), quoted, F.lit("}"))
    return ep.join(res, ep["id"] == res["request_id"], "left").select(
        ep["id"], F.when(F.col("graph_name").isNull(), "route_episode").otherwise("extract_episode").alias("task_name"), status.alias("status"), F.lit("extraction").alias("queue_name"),
        args.alias("args"), F.col("sent_at").alias("scheduled_at"), "agent_id", F.col("created_at").alias("started_at"), "batch_no",
    )


def job_events(jobs_: DataFrame) -> DataFrame:
    """(job_id, type, at): deferred when sent, started when received, and the end after as many seconds as the id's last two digits."""
    j = jobs_.select("id", "status", "scheduled_at", "started_at")
    later = F.timestamp_micros(F.unix_micros("started_at") + (F.col("id") % 100) * 1_000_000)
    return (
        j.select(F.col("id").alias("job_id"), F.lit("deferred").alias("type"), F.col("scheduled_at").alias("at")).where("at is not null")
        .unionByName(j.where("status <> 'todo'").select(F.col("id").alias("job_id"), F.lit("started").alias("type"), F.col("started_at").alias("at")))
        .unionByName(j.where("status in ('succeeded', 'failed')").select(F.col("id").alias("job_id"), F.col("status").alias("type"), later.alias("at")))
    )


#: The same views for the oracle, as common table expressions.
SQL = {
    "n": """n as (select * replace (coalesce(access_count, 0) as access_count, coalesce(importance, 0.5) as importance, coalesce(forgotten, false) as forgotten)
      from (select *, row_number() over (partition by id order by updated_at desc nulls last) as rn from graph_nodes where id is not null) where rn = 1)""",
    "e": "e as (select distinct graph_name, id, source_id, target_id, type_id, weight, last_reinforced_at, created_at, owner_role from graph_edges)",
    "ep0": "e0 as (select graph_name, id, any_value(properties) as properties from graph_edges group by all)",
    "nt": "nt as (select * from graph_node_types)",
    "et": "et as (select * from graph_edge_types)",
    "dom": "dom as (select * from (select *, row_number() over (partition by id order by updated_at desc nulls last) as rn from semantic_domains where id is not null) where rn = 1)",
    "ep": """ep as (select distinct request_id as id, agent_id, text as content, session_id, target_graph as graph_name, received_at as created_at, sent_at, batch_no, force_flag from ingest_requests)""",
    "ev": "ev as (select event_id as id, 'agent_' || user_id as agent_id, strftime(ts, '%Y-%m-%d') as session_id, ts as created_at from events)",
    "jb": """jb as (select ep.id, case when graph_name is null then 'route_episode' else 'extract_episode' end as task_name,
      case s when 'stored' then 'succeeded' when 'failed' then 'failed' when 'skipped' then 'cancelled' else 'todo' end as status, 'extraction' as queue_name,
      '{"agent_id": "' || coalesce(agent_id, '') || '", "episode_ids": [' || ep.id || '], "target_schema": ' || coalesce('"' || graph_name || '"', 'null') || '}' as args,
      sent_at as scheduled_at, agent_id, created_at as started_at, batch_no
      from ep left join (select distinct request_id, status as s from ingest_results) r on r.request_id = ep.id)""",
    "jv": """jv as (select id as job_id, 'deferred' as type, scheduled_at as at from jb where scheduled_at is not null
      union all select id, 'started', started_at from jb where status <> 'todo'
      union all select id, status, started_at + to_seconds(id % 100) from jb where status in ('succeeded', 'failed'))""",
}


def sql(names: str, body: str) -> str:
    """The named views in front of a query; a body that starts with ',' adds its own."""
    return "with " + ",\n".join(SQL[k] for k in names.split()) + ("\n" if not body.lstrip().startswith(",") else "") + body
