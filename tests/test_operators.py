"""Operators on small fixtures, among them nulls, ties and empty tables."""

from datetime import datetime as T

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.operators import facts, graph, ingest, jobs, pairs, retrieval, routing, sessions, steward, store
from loamgraph.plans.inspect import plan_facts
from loamgraph.sources import files

E = "graph_name string, id long, source_id long, target_id long, type_id long, weight double"


def edges(spark, *rows):
    return spark.createDataFrame([("g", i, *r) for i, r in enumerate(rows, 1)], E)


def test_neighbourhood(spark, rows):
    e = edges(spark, (1, 2, 1, 0.9), (3, 2, 1, 0.8), (3, 4, 1, 0.5), (4, 5, 1, 0.5), (2, None, 1, 0.1), (None, None, 1, None), (1, 1, 1, 1.0))
    out = graph.neighbourhood(spark.createDataFrame([("g", 1)], "graph_name string, id long"), e, 3)
    assert rows(out, "node", "distance", "edge_id") == [(2, 1, 1), (3, 2, 2), (4, 3, 3)]
    assert graph.neighbourhood(spark.createDataFrame([], "graph_name string, id long"), e, 2).count() == 0


def test_spreading(spark, rows):
    e = edges(spark, (1, 2, 1, 1.0), (2, 3, 1, 0.5), (9, 8, 1, 1.0), (1, 4, 1, None))
    out = graph.spreading_activation(spark.createDataFrame([("g", 1, 1.0)], "graph_name string, id long, score double"), e)
    assert [(a, round(b, 6)) for a, b in rows(out, "node", "bonus")] == [(2, 1.0), (3, 0.3)]


def test_supersession_and_cascade(spark, rows):
    e = edges(spark, (1, 2, 7, 1.0), (2, 3, 7, 1.0), (4, 5, 8, 1.0))
    t = spark.createDataFrame([(7, "SUPERSEDES"), (8, "USES")], "id long, name string")
    assert rows(graph.supersession_flags(e, t), "id", "is_target", "is_source") == [(1, False, True), (2, True, True), (3, True, False)]
    assert rows(graph.cascade_delete(e, spark.createDataFrame([("g", 3), ("h", 4)], "graph_name string, id long")), "id") == [(1,), (3,)]


def test_sessions(spark, rows):
    ep = spark.createDataFrame([(i, "a", "s" if i < 6 else None, T(2025, 1, 1, 0, i % 3)) for i in range(1, 8)], "id long, agent_id string, session_id string, created_at timestamp")
    assert rows(sessions.with_sequence(ep).where("session_id is not null"), "session_sequence", "id") == [(1, 3), (2, 1), (3, 4), (4, 2), (5, 5)]
    assert rows(sessions.with_previous(ep).where("session_id is not null"), "id", "prev_id") == [(1, 3), (2, 4), (3, None), (4, 1), (5, 2)]
    near = sessions.neighbours(ep, spark.createDataFrame([(4,), (7,)], "id long"), 3)
    assert rows(near, "neighbour_id", "offset") == [(1, -1), (2, 1), (5, 2)]


def test_trigram_pairs_find_what_brute_force_finds(spark, rows):
    names = ["Apache Kafka", "apache kafka", "Kafka", "Apache Kafkas", "Postgres", "PostgreSQL", None, "", "!!", "Hidden Engine", "Hidden Engines", "hidden  engine"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    from loamgraph.functions.text import trigram_similarity

    a, b = df.select(F.col("id").alias("a"), F.col("name").alias("na")), df.select(F.col("id").alias("b"), F.col("name").alias("nb"))
    for t in (0.3, 0.6, 0.9):
        want = a.crossJoin(b).where("a < b and na is not null and nb is not null").withColumn("s", trigram_similarity(F.col("na"), F.col("nb"))).where(F.col("s") >= t)
        assert rows(pairs.trigram_pairs(df, t), "id_a", "id_b") == rows(want, "a", "b")
    links = rows(pairs.name_links(df, 0.9), "id_a", "id_b", "sim")
    assert (0, 1, 1.0) in links and (9, 11, 1.0) in links and len(links) == len(set(links)) and all(a < b for a, b, _ in links)
    many = spark.range(200).selectExpr("id", "case when id < 150 then 'Apache Kafka' else 'Apache Kafkas' end as name")
    assert pairs.name_links(many, 0.6).count() == 149 + 49 + 1


def test_ingest_dedup(spark, rows):
    hist = spark.createDataFrame([("a", "hello"), ("b", "other")], "agent_id string, content string").select("agent_id", F.sha2("content", 256).alias("content_hash"), F.lit(1).cast("long").alias("id"))
    b = spark.createDataFrame([(10, "a", "hello", False), (11, "a", "new", None), (12, "a", "new", False), (13, "a", "new", True), (14, "b", "hello", False), (15, "a", None, False), (16, None, "new", False)], "id long, agent_id string, content string, force boolean")
    assert rows(ingest.dedup_batch(b, hist), "id", "status", "existing_id") == [(10, "skipped", 1), (11, "stored", None), (12, "skipped", 11), (13, "stored", None), (14, "stored", None), (15, "failed", None), (16, "stored", None)]


N = "graph_name string, id long, name string, type_name string, content string, importance double, access_count int, forgotten boolean, updated_at timestamp"


def test_node_upsert(spark, rows):
    nodes = spark.createDataFrame([("g", 1, "Apache Kafka", "Tool", "old", 0.5, 2, True, None), ("g", 2, "Serotonin", "Neurotransmitter", None, 0.5, 0, False, None), ("h", 3, "Redis", "Tool", None, 0.9, 0, False, None)], N)
    alias = spark.createDataFrame([("g", "kafka", 1)], "graph_name string, alias string, node_id long")
    delta = spark.createDataFrame(
        [("g", " apache  kafka", "Project", "new", 0.7, 1), ("g", "Kafka", "Tool", None, 0.2, 2), ("g", "Serotonin", "Drug", "x", 0.5, 3), ("g", "Redis", "Tool", None, 0.5, 4), ("g", None, "Tool", None, 0.5, 5), ("g", "redis", "Tool", "later", 0.1, 6)],
        "graph_name string, name string, type_name string, content string, importance double, seq long",
    )
    m = store.match_nodes(store.fold_delta(delta), nodes, alias)
    assert rows(m, "key", "node_id", "tier") == [("apache kafka", 1, 1), ("kafka", 1, 2), ("redis", None, None), ("serotonin", None, None)]
    out = store.upsert_nodes(nodes, m, "2025-01-01 00:00:00")
    assert rows(out, "id", "name", "content", "importance", "access_count", "forgotten") == [
        (1, "Apache Kafka", "new", 0.7, 3, False), (2, "Serotonin", None, 0.5, 0, False), (3, "Redis", None, 0.9, 0, False), (4, "Redis", "later", 0.5, 0, False), (5, "Serotonin", "x", 0.5, 0, False),
    ]
    assert store.match_nodes(store.fold_delta(delta.limit(0)), nodes, alias).count() == 0


def test_edge_upsert(spark, rows):
    old = spark.createDataFrame([("g", 1, 2, 5, 0.5), ("g", 3, 4, 5, 0.5), ("g", 3, 4, 6, 0.5)], "graph_name string, source_id long, target_id long, type_id long, weight double")
    new = spark.createDataFrame([("g", 1, 2, 9, 0.9, 1), ("g", 3, 4, 6, 0.8, 1), ("g", 3, 4, 7, 0.7, 2), ("g", 8, 9, 5, 0.1, 3), ("g", 8, 9, 5, 0.2, 4), ("g", None, 9, 5, 0.2, 4)], "graph_name string, source_id long, target_id long, type_id long, weight double, seq long")
    out = store.upsert_edges(old, new)
    assert rows(out, "source_id", "target_id", "type_id", "weight") == [(1, 2, 9, 0.9), (3, 4, 5, 0.5), (3, 4, 6, 0.8), (3, 4, 7, 0.7), (8, 9, 5, 0.2)]


def test_twenty_reinforcements_stay_below_the_ceiling(spark):
    e = edges(spark, (1, 2, 1, 1.0))
    ids = spark.createDataFrame([("g", 1)], "graph_name string, id long")
    w = [1.0]
    for _ in range(20):
        w.append(store.reinforce(edges(spark, (1, 2, 1, w[-1])), ids).first()["weight"])
    assert all(a < b for a, b in zip(w, w[1:])) and w[-1] < 1.5 and e.count() == 1


def test_type_changes(spark, rows):
    t = spark.createDataFrame([(1, "Condition"), (2, "Symptom"), (3, "HealthState"), (4, "Spare")], "id long, name string")
    n = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 3)], "id long, type_id long")
    moved, left = store.merge_types(n, t)
    assert rows(moved, "id", "type_id") == [(1, 2), (2, 2), (3, None), (4, 2)] and rows(left, "id") == [(2,), (4,)]
    assert rows(store.unused_types(t, n, ["Spare"]), "id") == [] and rows(store.unused_types(t, moved, []), "id") == [(1,), (3,), (4,)]
    assert rows(store.register(t, spark.createDataFrame([(9, "New"), (9, "New"), (1, "Condition")], "id long, name string"), ["name"]), "name") == [("Condition",), ("HealthState",), ("New",), ("Spare",), ("Symptom",)]


def test_versions(spark, tmp_path):
    store.write_version(spark.range(3), str(tmp_path), 1)
    assert store.read_version(spark, str(tmp_path), 1).count() == 3
    with pytest.raises(Exception, match="exists"):
        store.write_version(spark.range(1), str(tmp_path), 1)


def test_jobs(spark, rows):
    j = spark.createDataFrame([(1, "t", "todo"), (2, "t", "failed"), (3, "t", "succeeded"), (4, "t", "cancelled")], "id long, task_name string, status string")
    ev = spark.createDataFrame([(1, "deferred", T(2025, 1, 1)), (2, "started", T(2025, 1, 1)), (2, "failed", T(2025, 1, 2)), (2, "started", T(2025, 1, 2))], "job_id long, type string, at timestamp")
    assert rows(jobs.timeline(j, ev), "id", "started_at", "finished_at")[1] == (2, T(2025, 1, 2), T(2025, 1, 2))
    assert rows(jobs.stuck(j, ev, "2025-01-01 02:00:00", 60), "id", "waiting_minutes") == [(1, 120.0)]
    out, events = jobs.cancel(j, j.select("id"))
    assert rows(out, "id", "status") == [(1, "cancelled"), (2, "failed"), (3, "succeeded"), (4, "cancelled")] and rows(events, "job_id") == [(1,)]
    assert rows(jobs.retry(j, j.select("id")), "id", "old_id", "status") == [(5, 2, "todo"), (6, 4, "todo")]


def test_facts_are_idempotent(spark, rows):
    m = spark.createDataFrame([("bmw", "style", "Touring", 1), ("bmw", "style", " Touring ", 2), ("bmw", "year", "2020.0", 1), ("bmw", "year", "2020", 2), (None, "x", "y", 1), ("bmw", "style", "Sedan", 3)], "entity string, property string, value string, message long")
    f = facts.facts_of(m)
    assert rows(f, "property", "n_mentions") == [("style", 1), ("style", 2), ("year", 2)]
    assert facts.apply_facts(f, f).count() == 3 and rows(facts.conflicts(f), "property", "n_values") == [("style", 2)]


def test_cascade_takes_the_first_tier_that_finds_any(spark, rows):
    q = spark.createDataFrame([("KAFKA",), ("k-store",), ("Kafca",), ("zzz",)], "query string")
    n = spark.createDataFrame([(1, "Kafka"), (2, "kafka"), (3, "Redis"), (4, None)], "id long, name string")
    out = retrieval.cascade(q, n, spark.createDataFrame([("K-Store", 3)], "alias string, node_id long"))
    assert rows(out, "query", "id", "match_type") == [("KAFKA", 1, "1_exact"), ("KAFKA", 2, "1_exact"), ("Kafca", 1, "3_fuzzy"), ("Kafca", 2, "3_fuzzy"), ("k-store", 3, "2_alias")]


def test_mmr_prefers_what_is_new(spark):
    items = [("q", 1, 0.9, [1.0, 0.0]), ("q", 2, 0.85, [1.0, 0.0]), ("q", 3, 0.8, [1.0, 0.0]), ("q", 4, 0.75, [0.0, 1.0]), ("q", 5, 0.99, None)]
    df = spark.createDataFrame(items, "query string, id long, score double, embedding array<double>")
    got = [r["id"] for r in retrieval.mmr(df).orderBy("rank").collect()]
    assert got[0] == 1 and got.index(4) < got.index(3) and got[-1] == 5
    assert retrieval.mmr(df.limit(0)).count() == 0


def test_routing(spark, rows):
    t = spark.createDataFrame([(1, "a", "The API and the deadline"), (2, "a", None), (3, "b", "nothing here")], "id long, agent_id string, text string")
    assert rows(routing.classify(t), "id", "slug") == [(1, "technical_knowledge"), (1, "work_context")]
    dom = spark.createDataFrame([("work_context", "gw"), ("technical_knowledge", "gt")], "slug string, graph_name string")
    perm = spark.createDataFrame([("a", "gw", True, True), ("a", "gt", True, False)], "agent_id string, graph_name string, can_read boolean, can_write boolean")
    assert rows(routing.route(t, dom, perm), "id", "graph_name") == [(1, "gw")]


def test_steward(spark, rows):
    n = spark.createDataFrame([("big", i % 7, False) for i in range(21)] + [("small", 1, False), ("small", 1, True)], "graph_name string, type_id long, forgotten boolean")
    h = steward.health(n, edges(spark, (1, 2, 1, 1.0)), spark.createDataFrame([("big",)] * 3, "graph_name string"))
    assert rows(steward.proposals(h)) == [("big", "split"), ("small", "retire")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# hi")
    (tmp_path / "b.exe").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["accepted"]) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# hi", True), "b.exe": (None, False)}
    (tmp_path / "c.mp4").write_bytes(b"123")
    assert {r["kind"] for r in files.read_media(spark, str(tmp_path)).collect()} == {"video", "other"}
    ev = files.explode_json_events(spark.createDataFrame([(1, '[{"a":1},{"b":2}]'), (2, "no"), (3, None)], "k long, p string"), "k", "p")
    assert [(r["k"], r["position"]) for r in ev.orderBy("position").collect()] == [(1, 0), (1, 1)]
    files.write_audit(spark.range(2), str(tmp_path / "log"))
    assert files.read_audit(spark, str(tmp_path / "log"), "id long").count() == 2


def test_filters_reach_the_scan_and_nothing_is_paired_by_loops(spark):
    from loamgraph.queries import aggregates, filters

    d = "/root/testdata/sf0.001"
    f = plan_facts(filters.f2_by_name(spark, d))
    assert "EqualTo(name,Person)" in f["pushed"][0] and "description" not in f["read_schemas"][0]
    for q in (aggregates.j3_triples, aggregates.j4_connected_types, aggregates.j8_similar_names):
        g = plan_facts(q(spark, d))
        assert not g["nested_loops"] and not g["cartesian"] and not g["python"], q


def test_streams_resume_and_number_sessions(spark, tmp_path, rows):
    from loamgraph.streaming import pipelines as P

    src = str(tmp_path / "in" / "ep.parquet")
    first = spark.createDataFrame([(1, "a", "s", T(2025, 1, 1)), (2, "a", "s", T(2025, 1, 2)), (3, "b", "s", T(2025, 1, 1))], "id long, agent_id string, session_id string, created_at timestamp")
    first.coalesce(1).write.parquet(src)
    run = lambda: P.run_once(P.session_numbers(P.deduplicated(P.read_stream(spark, str(tmp_path / "in"), "ep"), ["id"])), checkpoint=str(tmp_path / "state"))
    assert rows(run(), "id", "session_sequence") == [(1, 1), (2, 2), (3, 1)]
    spark.createDataFrame([(2, "a", "s", T(2025, 1, 2)), (4, "a", "s", T(2024, 1, 1))], first.schema).coalesce(1).write.mode("append").parquet(src)
    assert rows(run(), "id", "session_sequence") == [(1, 1), (2, 2), (3, 1), (4, 3)]
    assert np.array([1]).sum() == 1
