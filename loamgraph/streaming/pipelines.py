"""Structured Streaming over episode and event files.

Every pipeline reads a folder as a stream with a fixed schema, can be stopped at any point and goes on
from its checkpoint. `run_once` works off what is there (trigger availableNow) and returns.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import shared_dir


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """folder/name.parquet, a file or a folder of files, as a stream; zone-less times become timestamps."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    single = _is_file(spark, path)
    df = r.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else r.parquet(path)
    casts = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def event_windows(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events per kind in tumbling windows; rows later than `late` behind the newest are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_windows(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 day", slide: str = "12 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n"))


def user_sessions(events: DataFrame, ts: str = "ts", gap: str = "12 hours", late: str = "10 minutes") -> DataFrame:
    """Events per user and session; a session ends with a gap without events."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def deduplicated(episodes: DataFrame, key: list[str]) -> DataFrame:
    """The first row of every key. State grows with the number of keys; use deduplicated_within for bounded state."""
    return episodes.dropDuplicates(key)


def deduplicated_within(episodes: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    return episodes.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def session_numbers(episodes: DataFrame) -> DataFrame:
    """(agent_id, session_id, id, session_sequence): a running number per session, in order of (created_at, id) within a micro-batch.

    An episode that arrives late gets the next number on arrival. One counter per session is kept as state.
    """

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        pdf = pd.concat(list(parts)).sort_values(["created_at", "id"])
        seq = range(n + 1, n + 1 + len(pdf))
        state.update((n + len(pdf),))
        yield pd.DataFrame({"agent_id": [key[0]] * len(pdf), "session_id": [key[1]] * len(pdf), "id": pdf["id"].to_numpy(), "session_sequence": list(seq)})

    return episodes.groupBy("agent_id", "session_id").applyInPandasWithState(number, "agent_id string, session_id string, id bigint, session_sequence bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Work off the available input into a Parquet table of the shared folder and read that table.

    In mode 'complete' the last full result is the table; in 'append' each micro-batch adds its rows. A batch that is
    run again after a failure replaces what it wrote before.
    """
    spark = df.sparkSession
    root = checkpoint or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch=0" if mode == "complete" else f"{out}/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(root, "checkpoint")).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/batch=*")
