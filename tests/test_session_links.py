"""Session links of a whole table: episode ids beyond the first ten thousand."""

from datetime import datetime as T

from loamgraph.queries import graphs


def test_large_episode_ids_are_not_folded(spark, rows, tmp_path):
    ev = [(7, T(2025, 1, 1, 8), 1), (10007, T(2025, 1, 1, 9), 1), (20007, T(2025, 1, 1, 10), 1), (54321, T(2025, 1, 1, 8), 2), (98765, T(2025, 1, 1, 9), 2), (99999, T(2025, 1, 1, 10), 2)]
    spark.createDataFrame(ev, "event_id long, ts timestamp, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    source = [(1, "10007"), (2, "20007"), (3, "54321"), (4, "98765"), (5, "98765"), (6, "110007"), (8, "x"), (9, None)]
    nodes = [(i, {"_source_episode": e} if e else {}, T(2025, 2, 1, 0, i), T(2025, 2, 1, 0, i)) for i, e in source]
    spark.createDataFrame(nodes, "id long, properties map<string,string>, created_at timestamp, updated_at timestamp").write.parquet(f"{tmp_path}/graph_nodes.parquet")
    assert rows(graphs.n8_session_links(spark, str(tmp_path))) == [(2, 1, 0.9), (4, 3, 0.9)]
