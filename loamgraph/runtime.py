"""Session defaults, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def local_session(app: str = "loamgraph", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; zone-less timestamps become timestamps in the session zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. In local mode, where it may be unset, one of our own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loamgraph-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join that shuffles both: a broadcast is built in the driver, and rows of lists or sketches take many times what their compressed tables let expect."""
    return df.hint("merge")


def cut_counted(df: DataFrame, **what: Column) -> tuple[DataFrame, dict[str, int]]:
    """As cut, with aggregates of the rows written that are taken on the way, without reading the table again."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in what.items()]))
    return out, {k: seen.get[k] or 0 for k in what}


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds out: 1, 2, ... in the given order, without a task that sees all rows: the sorted ranges are written and counted, then numbered each on its own."""
    parts = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(offset), "_part").withColumn(out, (F.col("_off") + inside).cast("bigint")).drop("_part", "_off")


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` returned; nothing that is still to be computed may read them."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
