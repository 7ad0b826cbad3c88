"""Session numbers of a folder of more files than a micro-batch reads by default, newest rows in the first file."""

from datetime import datetime as T

from loamgraph.queries import streams


def test_numbers_do_not_depend_on_files(spark, rows, tmp_path):
    schema = "request_id long, agent_id string, session_id string, received_at timestamp"
    for i in range(6, 0, -1):
        spark.createDataFrame([(i, "a", "s", T(2025, 1, i)), (i + 10, "a", None, T(2025, 1, i))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ingest_requests.parquet")
    assert rows(streams.k5_session_numbers(spark, str(tmp_path))) == [(i, i) for i in range(1, 7)]
