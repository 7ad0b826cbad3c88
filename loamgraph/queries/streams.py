"""Streaming queries: each works off a folder as a stream and returns the table it filled."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import scoring as S
from ..runtime import table
from ..streaming import pipelines as P
from ..views import sql

# One mean per hour and kind; the stream's state holds one row per open window.


def stream_event_windows(s, d):
    out = P.run_once(P.event_windows(P.read_stream(s, d, "events")), "complete")
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sliding_windows(s, d):
    out = P.run_once(P.sliding_windows(P.read_stream(s, d, "events")), "complete")
    return out.select(F.col("w.start").alias("start"), "n")


def k3_routed_stream(s, d):
    """Requests are classified while they stream in; each goes to every domain it names."""
    from ..operators.routing import classify

    src = P.read_stream(s, d, "ingest_requests").select(F.col("request_id").alias("id"), "text")
    return P.run_once(classify(src)).select("id", "slug").distinct()


def stream_user_sessions(s, d):
    """Sessions of a static table; the same expression runs on a stream."""
    e = table(s, d, "events")
    return e.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def k5_session_numbers(s, d):
    """Numbers follow arrival; all files are one batch here, as the order of files means nothing."""
    src = P.read_stream(s, d, "ingest_requests", files_per_trigger=2**31 - 1).where("session_id is not null").select(F.col("request_id").alias("id"), "agent_id", "session_id", F.col("received_at").alias("created_at"))
    return P.run_once(P.session_numbers(P.deduplicated(src, ["id"]))).select("id", "session_sequence")


def k6_hash_dedup(s, d):
    src = P.read_stream(s, d, "ingest_requests").where("text is not null").select("agent_id", F.sha2("text", 256).alias("hash"))
    return P.run_once(P.deduplicated(src, ["agent_id", "hash"])).select("agent_id", "hash")


def k8_short_term(s, d):
    e = table(s, d, "events")
    return e.where(S.hours_since(F.col("ts"), "2024-01-15 00:00:00") < S.STM_WINDOW_HOURS).where("ts <= timestamp '2024-01-15 00:00:00'").select("event_id", "user_id")


def k9_poll(s, d):
    j = V.jobs(s, d)
    return j.groupBy("task_name", "status").agg(F.count("*").alias("n"), F.max("scheduled_at").alias("newest"))


QUERIES = {k: f for k, f in list(globals().items()) if (k[0] == "k" and k[1:2].isdigit()) or k.startswith("stream_")}
SQL = {
    "stream_event_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "stream_sliding_windows": """with x as (select ts, epoch_us(ts) // 43200000000 as half from events) select make_timestamp((half - o) * 43200000000) as start, count(*) as n from x, (select unnest([0, 1]) as o) group by 1""",
    "k3_routed_stream": """with kw as (select * from (values ('user_profile', ['prefer', 'goal', 'habit', 'like', 'dislike', 'want', 'value', 'opinion']),
      ('technical_knowledge', ['python', 'react', 'api', 'database', 'framework', 'library', 'code', 'architecture']),
      ('work_context', ['project', 'task', 'deadline', 'meeting', 'team', 'milestone', 'sprint']), ('domain_knowledge', ['concept', 'theory', 'fact', 'research', 'trend', 'industry'])) v(slug, words))
      select distinct request_id as id, slug from ingest_requests, kw where text is not null and len(list_filter(words, lambda w: contains(lower(text), w))) > 0""",
    "stream_user_sessions": """with g as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval 12 hours, true) as new from events window w as (partition by user_id order by ts)),
      s as (select *, sum(new::int) over (partition by user_id order by ts rows unbounded preceding) as nr from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, nr""",
    "k5_session_numbers": sql("ep", "select id, row_number() over (partition by agent_id, session_id order by created_at, id) as session_sequence from ep where session_id is not null"),
    "k6_hash_dedup": "select distinct agent_id, sha256(text) as hash from ingest_requests where text is not null",
    "k8_short_term": "select event_id, user_id from events where ts <= timestamp '2024-01-15 00:00:00' and ts > timestamp '2024-01-14 22:00:00'",
    "k9_poll": sql("ep jb", "select task_name, status, count(*) as n, max(scheduled_at) as newest from jb group by 1, 2"),
}
